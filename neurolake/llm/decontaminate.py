"""Benchmark decontamination: token windows against a broadcast hash set of benchmark n-grams (operator 1)."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.llm import _frames, _text

WINDOW = 10
#: bytes of benchmark text whose windows are broadcast at once; a larger benchmark takes several passes over the documents
BLOCK_BYTES = 16 << 20

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class WindowSet:
    """The normalised windows of some benchmark items, by 64-bit hash, with the windows themselves to verify hits."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.n = n
        self.owners: dict[bytes, set[str | None]] = {}
        by_length: dict[int, dict[int, None]] = {}
        for item, text in items:
            found = _WORD.findall((text or "").encode().lower())
            length = min(n, len(found))
            for i in range(len(found) - length + 1 if found else 0):
                window = found[i : i + length]
                self.owners.setdefault(b" ".join(window), set()).add(item)
                by_length.setdefault(length, {})[self.hash(window)] = None
        self.sets = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in by_length.items()}
        self.sieves = {}
        for k, v in self.sets.items():
            self.sieves[k] = sieve = np.zeros(1 << 20, bool)
            sieve[(v & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @staticmethod
    def hash(window: list[bytes]) -> int:
        buf = np.frombuffer(b"".join(window), np.uint8)
        ends = np.cumsum([len(w) for w in window])
        h = _text.word_hashes(buf, ends - [len(w) for w in window], ends)
        return int(rolled(h, len(window))[0])

    def hits(self, h: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
        """Positions where a window's hash is in the set, within rows."""
        g = rolled(h, length)
        maybe = np.flatnonzero(self.sieves[length][(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        known = self.sets[length]
        at = np.minimum(np.searchsorted(known, g[maybe]), len(known) - 1)
        maybe = maybe[known[at] == g[maybe]]
        row = np.searchsorted(first, maybe, side="right") - 1
        return maybe[maybe + length <= first[row + 1]]


def rolled(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of so many word hashes."""
    n = max(0, len(h) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(0x9DDFEA08EB382D69) + h[k : k + n]
    return _text.mix(out)


def _scan(texts: pa.Array, had: list, windows: WindowSet) -> tuple[list, list, list]:
    """(n_words, hit spans as flat [start, end) bytes of text, items) of each row. had: the spans and items of earlier passes, or none."""
    n_words, spans, items = [], [], []
    for r0, r1, buf, offsets in _text.chunks(texts):
        starts, ends, first = _text.words(buf, offsets, _text.ALNUM)
        low = _text.LOWER[buf]
        n_words += np.diff(first).tolist()
        hit = np.zeros(len(starts) + 1, np.int64)
        found: dict[int, set] = {}
        if len(starts):
            h = _text.word_hashes(low, starts, ends)
            for length in windows.sets:
                for i in windows.hits(h, first, length).tolist():
                    said = b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + length))
                    if (who := windows.owners.get(said)) is not None:
                        hit[i] += 1
                        hit[i + length] -= 1
                        found.setdefault(int(np.searchsorted(first, i, side="right")) - 1, set()).update(who)
        marked = np.cumsum(hit)[:-1] > 0
        for r in range(r1 - r0):
            earlier = had[r0 + r] if had else None
            if r not in found and not earlier:
                spans.append([])
                items.append([])
                continue
            mine = marked[first[r] : first[r + 1]].copy()
            who = set(found.get(r, ()))
            s, e = starts[first[r] : first[r + 1]] - offsets[r], ends[first[r] : first[r + 1]] - offsets[r]
            if earlier:
                for a, b in zip(earlier[0][::2], earlier[0][1::2]):
                    mine[(s >= a) & (e <= b)] = True
                who |= set(earlier[1])
            edge = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
            flat = np.stack([s[np.flatnonzero(edge == 1)], e[np.flatnonzero(edge == -1) - 1]], axis=1).reshape(-1)
            spans.append(flat.tolist())
            items.append(sorted(who, key=lambda x: (x is not None, x or "")))
    return n_words, spans, items


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words (int), hit_spans (bytes of the text, flat starts and ends) and hit_items (the items' ids as strings, sorted).

    Null and empty texts have no words. Items without words have no windows; an item without an id counts under a null id,
    and rows that repeat an id are one item. A text of any length is scanned whole. The benchmark is broadcast in blocks of
    items of at most about block_bytes (an item alone may be longer); each block is a pass that adds to the row, without a shuffle.
    Of several blocks one at a time is held by the workers, and the rows are written in between.
    """
    spark = _frames.ready(docs.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    n_blocks = max(1, -(-total // block_bytes))
    out = docs
    for k in range(n_blocks):
        mine = rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        shared = spark.sparkContext.broadcast(WindowSet([(r["item_id"], r["text"]) for r in mine.collect()], n))

        def add(batch: pa.RecordBatch, shared=shared, k=k) -> dict[str, pa.Array]:
            had = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_spans", "hit_items")))) if k else []
            n_words, spans, items = _scan(_frames.text_column(batch), had, shared.value)
            return {"n_words": pa.array(n_words, pa.int32()), "hit_spans": pa.array(spans, pa.list_(pa.int32())), "hit_items": pa.array(items, pa.list_(pa.string())), "n_hit": pa.array(_count(_frames.text_column(batch), spans), pa.int32())}

        out = _frames.add_columns(out, [("n_words", "int"), ("hit_spans", "array<int>"), ("hit_items", "array<string>"), ("n_hit", "int")], add)
        if n_blocks > 1:
            # one block at a time is broadcast
            out = _frames.cut(out)
            shared.destroy()
    return out


def _count(texts: pa.Array, spans: list) -> list[int]:
    """Words inside the spans."""
    out = [0] * len(spans)
    for i, flat in enumerate(spans):
        if flat:
            raw = texts[i].as_py().encode()
            out[i] = sum(len(_WORD.findall(raw[a:b].lower())) for a, b in zip(flat[::2], flat[1::2]))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW) -> DataFrame:
    """docs less what the benchmark leaked into. remove="documents" drops rows with a hit; "spans" cuts the hit words out of the text.

    All other columns are handed on. A cut leaves a single space; n_chars, if there is one, follows the new text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    scanned = scan(docs, benchmark, n)
    made = ("n_words", "hit_spans", "hit_items", "n_hit")
    if remove == "documents":
        return scanned.where("n_hit = 0").drop(*made)

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for text, flat in zip(_frames.text_column(batch).to_pylist(), batch.column(batch.schema.get_field_index("hit_spans")).to_pylist()):
            if flat:
                raw, at, parts = text.encode(), 0, []
                for a, b in zip(flat[::2], flat[1::2]):
                    parts.append(raw[at:a].strip())
                    at = b
                text = b" ".join(filter(None, [*parts, raw[at:].strip()])).decode()
            out.append(text)
        return {"text": pa.array(out, pa.string())}

    cleaned = _frames.add_columns(scanned, [("text", "string")], cut)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its words, the words inside benchmark windows, the items whose windows occur."""
    docs = _frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = scan(docs, _frames.table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
h AS (SELECT DISTINCT r, dw.k, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
SQL = {"op1_decontamination": OP1_SQL}
