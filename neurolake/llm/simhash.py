"""SimHash near-duplicates: fingerprints of word shingles, linked on vertical bit planes (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.llm import _frames, _links, _minhash, _text

#: ids to keep that are broadcast at most; beyond, documents and ids are joined by shuffle
BROADCAST_IDS = 4_000_000


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, starts, ends, first shingle of each row): lower-cased words joined by one space; a text of fewer words is one shingle, of none has none."""
    starts, ends, first = _text.words(buf, offsets, _text.NONSPACE)
    n_words = np.diff(first)
    lengths = ends - starts
    total = int(lengths.sum()) + len(starts)
    place = np.cumsum(lengths + 1) - (lengths + 1)
    out = np.full(total, 0x20, dtype=np.uint8)
    keep = _text.NONSPACE[buf]
    # the n-th kept byte goes n places plus the spaces before it
    out[np.arange(total - len(starts)) + np.repeat(np.arange(len(starts)), lengths)] = _text.LOWER[buf[keep]]
    count = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    sh_first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - sh_first[:-1][row]
    w0 = first[:-1][row] + nth
    w1 = np.minimum(w0 + size, first[1:][row]) - 1
    return out, place[w0], place[w1] + lengths[w1], sh_first


def fingerprints(texts: pa.Array, size: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of every text: a bit is 1 if set in over half the XXH64 of its shingles; 0 without words."""
    out = [np.zeros(0, np.uint64)]
    for _, _, buf, offsets in _text.chunks(texts):
        norm, starts, ends, first = shingles(buf, offsets, size)
        h = _text.xxh64(norm, starts, ends, seed)
        out.append(_text.majority(_text.bit_counts(h, first), np.diff(first)))
    return np.concatenate(out)


def with_fingerprint(docs: DataFrame, size: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """docs with column fp (long, the 64 bits as signed)."""
    return _frames.add_columns(docs, [("fp", "long")], lambda b: {"fp": pa.array(fingerprints(_text_of(b), size, seed).view(np.int64))}, keep)


def _text_of(batch: pa.RecordBatch) -> pa.Array:
    return _frames.text_column(batch)


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): a row per row of docs; component_id is the smallest doc_id reachable over links of at most radius bits.

    Links join different fingerprints; rows of one fingerprint meet in it and are never paired. Null and empty texts have
    fingerprint zero and are linked like any other. A row without doc_id belongs to its component; a component of none but
    such rows has a null id. An empty table gives an empty result.
    """
    prints = _frames.cut(with_fingerprint(docs.select("doc_id", "text"), size, seed, ["doc_id"]))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = _frames.cut(_links.hamming_links(prints.select("fp"), radius))
    if links.isEmpty():
        named = least.withColumnRenamed("least", "component_id")
    else:
        comp = _links.components(links)
        member = least.join(comp, least.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
        member = _frames.cut(member)
        head = member.groupBy("root").agg(F.min("least").alias("component_id"))
        named = member.join(head, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _shingle_sets(texts: pa.Array, size: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingle hashes, first of each row), chunk by chunk."""
    for _, _, buf, offsets in _text.chunks(texts):
        norm, starts, ends, first = shingles(buf, offsets, size)
        yield _minhash.distinct(_text.xxh64(norm, starts, ends, seed), first)


def _print_edges(signed: DataFrame, radius: int = 3) -> DataFrame:
    """(a long, b long) of (node long, fp long): every node is linked to the least of those whose fingerprints are in one component of links of at most radius bits."""
    each = signed.distinct()
    links = _frames.cut(_links.hamming_links(each.select("fp"), radius))
    named = each.select("node", F.col("fp").alias("root"))
    if not links.isEmpty():
        comp = _links.components(links)
        named = each.join(comp, each.fp == comp.node, "left").select(each.node, F.coalesce("component", "fp").alias("root"))
    named = _frames.cut(named)
    heads = named.groupBy("root").agg(F.min("node").alias("b"), F.max("node").alias("_top")).where("b <> _top").select("root", "b")
    return named.join(heads, "root").where("node <> b").select(F.col("node").alias("a"), "b")


def set_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, component_id): a row per row of docs; component_id is the smallest doc_id reachable over pairs whose sets of word
    shingles have a Jaccard similarity of at least so much.

    Candidates are texts whose SimHashes hang together as in near_duplicates() and, for the many pairs that those miss, texts that
    share a MinHash band; every candidate group is then compared by its whole sets. Texts without words have the same, empty set.
    Rows without doc_id belong to their component as in near_duplicates().
    """

    def sign(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        node, keys = [np.zeros(0, np.uint64)], []
        for h, first in _shingle_sets(_text_of(batch), size, seed):
            node.append(_minhash.nodes(h, first))
            keys += [k.tobytes() for k in _minhash.band_keys(h, first)]
        return {"fp": pa.array(fingerprints(_text_of(batch)).view(np.int64)), "node": pa.array(np.concatenate(node).view(np.int64)), "keys": pa.array(keys, pa.binary())}

    signed = _frames.cut(_frames.add_columns(docs.select("doc_id", "text"), [("fp", "long"), ("node", "long"), ("keys", "binary")], sign, ["doc_id"]))
    sets = _frames.cut(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")))
    edges = _frames.cut(_print_edges(signed.select("node", "fp")).union(_minhash.candidate_edges(sets)))
    if edges.isEmpty():
        named = sets.select("node", F.col("least").alias("component_id"))
        return signed.join(named, "node").select("doc_id", "component_id")
    groups = _frames.cut(_links.components(edges).join(sets.select("node", "least"), "node"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, first in _shingle_sets(_text_of(batch), size, seed):
                loads = [h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(_minhash.nodes(h, first).view(np.int64)), pa.array(loads, pa.binary())], names=["node", "load"])

    ids = _frames.cut(groups.select(F.col("least").alias("at")).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    holding = docs.join(ids, docs["doc_id"].eqNullSafe(ids["at"]), "left_semi").select("text")
    found = holding.mapInArrow(read, "node long, load binary").groupBy("node").agg(F.first("load").alias("load"))
    parts = 4 * _frames.partitions(docs.sparkSession)
    dealt = found.join(groups.select("node", "component"), "node").withColumn("k", F.pmod(F.xxhash64("component"), F.lit(parts)))

    def compare(group: pa.Table) -> pa.Table:
        node, comp = group.column("node").to_numpy(), group.column("component").to_numpy()
        load = group.column("load").to_pylist()
        order = np.lexsort((node, comp))
        root = node.copy()
        for at in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            root[at] = node[at][_minhash.clusters([np.frombuffer(load[i], np.uint64) for i in at.tolist()], least)]
        _frames.trim()
        return pa.table({"node": node, "root": root})

    rooted = _frames.cut(dealt.select("k", "node", "component", "load").groupBy("k").applyInArrow(compare, "node long, root long"))
    member = _frames.cut(sets.select("node", "least").join(rooted, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    head = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.join(member.join(head, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def _first_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    kept = _frames.cut(named.where("doc_id <=> component_id").select(F.col("doc_id").alias("_kept_id")).distinct())
    if kept.count() <= BROADCAST_IDS:
        kept = F.broadcast(kept)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")


def drop_near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """docs with one row of each near-duplicate component: the row of the smallest doc_id.

    Rows that share that doc_id are kept or dropped together, so rows repeated under one id stay for an exact distinct.
    Rows without doc_id stay only in a component of none but such rows. All columns are handed on unchanged.
    """
    return _first_of_each(docs, near_duplicates(docs, size, radius))


def drop_set_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each component of set_duplicates(), kept as by drop_near_duplicates()."""
    return _first_of_each(docs, set_duplicates(docs, size, least))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint (16 hex digits) and component."""
    got = near_duplicates(_frames.table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
