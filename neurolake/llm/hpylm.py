"""Hierarchical Pitman-Yor language model: Chinese-restaurant seating sampled by Gibbs (operator 5).

A restaurant for each context word and one for the empty context, their parent. Customers of a context are the words that
follow it in the training texts; each table of a context sends a customer to the parent, whose own parent is uniform over the
vocabulary and one unknown word.

Tokens are dealt once, packed and by context word, into buckets that hold whole restaurants; the one exchange serves the
seating and the scoring. Words are dealt by hash to gather counts and parent customers, and the answers go back in the order
of the requests. Nothing of the corpus passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.llm import _frames, _text

#: discount and strength of the contexts and of the parent
DISCOUNT, STRENGTH = 0.8, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
#: Gibbs sweeps that are thrown away and that are averaged
BURN, SWEEPS = 1, 2
SEED = 1_729
#: bytes of text behind a bucket and in a packed piece
BUCKET_BYTES, PIECE_BYTES = 18 << 20, 6 << 20
#: a context of over this part of a bucket is dealt over up to SPREAD buckets; found in a sample of about so many bytes, which balances but never counts
HOT, SPREAD, HOT_SAMPLE = 0.25, 16, 8 << 20
#: customers of a dish up to which the number of tables is drawn from its exact conditional
EXACT = 24

_END, _BEGIN = np.uint64(0x5BF0_3635_1A9B_17C3), np.uint64(0x27BB_2EE6_87B0_B0FD)


def stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for discount d: the weight of all seatings of c customers at t tables."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, n + 1):
        for t in range(1, c + 1):
            out[c, t] = np.logaddexp(out[c - 1, t - 1], (math.log(c - 1 - d * t) if c - 1 - d * t > 0 else -np.inf) + out[c - 1, t])
    return out


_tables = {d: stirling(d) for d in (DISCOUNT, ROOT_DISCOUNT)}


def seat(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Draws the number of tables of each dish given its customers, the parent's probability and the tables of other dishes in its restaurant.

    Up to EXACT customers: from the exact conditional, the Stirling weight of the seatings times the chances of so many new tables.
    Beyond: customers sit down in turn, and the waiting time to the next new table is drawn at once.
    """
    t = np.minimum(c, 1).astype(np.int64)
    log_s = _tables.get(d)
    if log_s is None:
        log_s = _tables[d] = stirling(d)
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    few = few[np.argsort(c[few], kind="stable")]
    sizes = c[few]
    cuts = np.searchsorted(sizes, np.arange(2, EXACT + 2))
    for k in range(2, EXACT + 1):
        at = few[cuts[k - 2] : cuts[k - 1]]
        for part in np.split(at, range(100_000, len(at), 100_000)):
            if len(part):
                j = np.arange(k)
                rise = np.cumsum(np.log((theta + d * (others[part][:, None] + j)) * base[part][:, None]), axis=1)
                draw = rise + log_s[k, 1 : k + 1] - np.log(rng.standard_exponential((len(part), k)))
                t[part] = 1 + np.argmax(draw, axis=1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        n, tables = np.ones(len(many)), np.ones(len(many), np.int64)
        act = np.arange(len(many))
        while len(act):
            dish = many[act]
            chance = (theta + d * (others[dish] + tables[act])) * base[dish]
            taken = d * tables[act]
            with np.errstate(over="ignore", divide="ignore"):
                n[act] = taken + np.maximum(n[act] - taken, 1 - d) * np.exp(rng.standard_exponential(len(act)) / chance)
            n[act] = np.maximum(n[act], tables[act] + 1)
            act = act[n[act] <= c[many[act]]]
            tables[act] += 1
        t[many] = np.minimum(tables, c[many])
    return t


def gibbs(c: np.ndarray, base: np.ndarray, group: np.ndarray, n_groups: int, extra: np.ndarray, d: float, theta: float, rng: np.random.Generator, burn: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """(last tables, mean tables over the sweeps after burn-in) of each dish. group: its restaurant; extra: tables of the restaurant that are kept elsewhere."""
    t = np.minimum(c, 1).astype(np.int64)
    mean = np.zeros(len(c))
    for k in range(burn + sweeps):
        total = np.bincount(group, weights=t, minlength=n_groups) + extra
        t = seat(c, base, total[group] - t, d, theta, rng)
        if k >= burn:
            mean += t
    return t, mean / max(1, sweeps)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), {"u": 0, "i": 1, "f": 2}[a.dtype.kind] * 16 + a.dtype.itemsize)]], np.int64)
    return b"".join([head.tobytes(), *[a.tobytes() for a in arrays]])


def _unpack(load: pa.Scalar) -> list[np.ndarray]:
    buf = load.as_buffer()
    n = int(np.frombuffer(buf, np.int64, 1)[0])
    head = np.frombuffer(buf, np.int64, 1 + 2 * n)[1:]
    at, out = 8 * (1 + 2 * n), []
    for k in range(n):
        kind = np.dtype(f"{'uif'[int(head[2 * k + 1]) // 16]}{int(head[2 * k + 1]) % 16}")
        out.append(np.frombuffer(buf, kind, int(head[2 * k]), at) if head[2 * k] else np.zeros(0, kind))
        at += int(head[2 * k]) * kind.itemsize
    return out


def _bucket(u: np.ndarray, n: int) -> np.ndarray:
    return ((_text.mix(u + np.uint64(77)) >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each row): words lower-cased, then one end for each row."""
    starts, ends, first = _text.words(buf, offsets, _text.NONSPACE)
    rows = len(first) - 1
    h = _text.word_hashes(_text.LOWER[buf], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    out = np.full(len(h) + rows, _END, np.uint64)
    row = _text.rows_of(first)
    out[np.arange(len(h)) + row] = h
    return out, first + np.arange(rows + 1)


class Pieces:
    """The packed pieces of a bucket, with equal pairs of context and word brought together."""

    def __init__(self, loads: list[list[np.ndarray]]):
        self.loads = loads
        each_u = [np.repeat(x[1], x[2]) for x in loads]
        u = np.concatenate(each_u) if loads else np.zeros(0, np.uint64)
        w = np.concatenate([x[3] for x in loads]) if loads else np.zeros(0, np.uint64)
        del each_u
        seen = []
        for _, _, _, pw, count, doc, train, *_ in loads:
            firsts = np.cumsum(count, dtype=np.int64) - count
            seen.append(np.add.reduceat(train[doc].astype(np.int64), firsts) if len(pw) else np.zeros(0, np.int64))
        key = _text.combine(u, w)
        order = np.argsort(key)
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        del key
        self.pair = np.empty(len(order), np.int32)  # of each piece's pairs in turn
        self.pair[order] = np.cumsum(fresh) - 1
        self.c = np.add.reduceat(np.concatenate(seen)[order], at) if len(at) else np.zeros(0, np.int64)
        chosen = order[at]
        del order
        self.contexts, self.u = np.unique(u[chosen], return_inverse=True)
        self.words, self.w = np.unique(w[chosen], return_inverse=True)
        self.c_u = np.bincount(self.u, weights=self.c, minlength=len(self.contexts))
        self.c_w = np.bincount(self.w, weights=self.c, minlength=len(self.words)).astype(np.int64)


def _emit(n_buckets: int, hot: np.ndarray):
    """Map side: pieces of about PIECE_BYTES of text, dealt by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        serial = 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        infos: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, size
            w = np.concatenate([x[0] for x in held])
            count = np.concatenate([np.diff(x[1]) for x in held])
            held_out = np.concatenate([x[2] for x in held])
            ids, known = (np.concatenate([x[k] for x in infos]) for k in (0, 1))
            first = np.concatenate([[0], np.cumsum(count)])
            u = np.empty_like(w)
            u[1:] = w[:-1]
            u[first[:-1]] = _BEGIN
            doc = np.repeat(np.arange(len(count), dtype=np.uint32), count)
            b = _bucket(u, n_buckets)
            if len(hot):
                near = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
                is_hot = hot[near] == u
                b[is_hot] = (b[is_hot] + (_text.mix(w[is_hot]) % np.uint64(min(SPREAD, n_buckets))).astype(np.int64)) % n_buckets
            order = np.argsort((b.astype(np.uint64) << np.uint64(48)) | (_text.mix(u) >> np.uint64(40) << np.uint64(24)) | (_text.combine(u, w) >> np.uint64(40)), kind="stable")
            u, w, b, doc = u[order], w[order], b[order], doc[order]
            if len(count) <= 1 << 16:
                doc = doc.astype(np.uint16)
            new = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]) | (b[1:] != b[:-1])])
            pair = np.flatnonzero(new)
            amount = np.diff(np.append(pair, len(w))).astype(np.uint32)
            pu, pw, pb = u[pair], w[pair], b[pair]
            turn = np.flatnonzero(np.concatenate([[True], (pu[1:] != pu[:-1]) | (pb[1:] != pb[:-1])]))
            length = np.diff(np.append(turn, len(pu))).astype(np.uint32)
            serial += 1
            piece = part << 24 | serial
            train = (~held_out).astype(np.uint8)
            keys, loads = [], []
            bt, bp, bw = (np.searchsorted(x, np.arange(n_buckets + 1)) for x in (pb[turn], pb, b))
            home = piece * 2654435761 % n_buckets
            for k in range(n_buckets):
                if bw[k] == bw[k + 1] and k != home:
                    continue
                info = [ids, known, count.astype(np.uint32)] if k == home else []
                keys.append(k)
                loads.append(_pack(np.array([piece], np.int64), pu[turn][bt[k] : bt[k + 1]], length[bt[k] : bt[k + 1]], pw[bp[k] : bp[k + 1]], amount[bp[k] : bp[k + 1]], doc[bw[k] : bw[k + 1]], train, *info))
            held.clear()
            infos.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(loads, pa.binary())], names=["b", "load"])

        for batch in batches:
            ids, held_out = _frames.text_column(batch, "doc_id"), _frames.text_column(batch, "held_out")
            out, known = ids.fill_null(0).to_numpy(zero_copy_only=False), (~np.asarray(ids.is_null())).astype(np.uint8)
            flag = held_out.to_numpy(zero_copy_only=False).astype(bool)
            for r0, r1, buf, offsets in _text.chunks(_frames.text_column(batch)):
                w, first = tokens(buf, offsets)
                held.append((w, first, flag[r0:r1]))
                infos.append((out[r0:r1], known[r0:r1]))
                size += len(buf) + r1 - r0
                if size >= PIECE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def _loads(table: pa.Table) -> list[list[np.ndarray]]:
    return [_unpack(x) for x in table.column("load")]


def _rng(seed: int, *key: int) -> np.random.Generator:
    return np.random.default_rng([seed, *key])


def _hot_in(contexts: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Indices of the contexts that are dealt over several buckets."""
    if not len(hot):
        return np.zeros(0, np.int64)
    near = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
    return np.flatnonzero(hot[near] == contexts)


def _request(p: Pieces, b: int, t: np.ndarray, hot: np.ndarray, n_buckets: int) -> pa.Table:
    """What a bucket asks of the words' buckets: for each word, its customers and tables here; for each spread context, the same."""
    t_w = np.bincount(p.w, weights=t, minlength=len(p.words)).astype(np.int64)
    t_u = np.bincount(p.u, weights=t, minlength=len(p.contexts)).astype(np.int64)
    h = _hot_in(p.contexts, hot)
    at, hb = _bucket(p.words, n_buckets), _bucket(p.contexts[h], n_buckets)
    keys, loads = [], []
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(n_buckets + 1))
    for k in range(n_buckets):
        mine, spread = order[cuts[k] : cuts[k + 1]], h[hb == k]
        if len(mine) or len(spread):
            keys.append(k)
            loads.append(_pack(np.array([b], np.int64), p.words[mine], p.c_w[mine].astype(np.uint32), t_w[mine].astype(np.uint32), p.contexts[spread], p.c_u[spread].astype(np.int64), t_u[spread]))
    return pa.table({"wb": pa.array(keys, pa.int32()), "load": pa.array(loads, pa.binary())})


class Parent:
    """The parent restaurant's part in a words' bucket."""

    def __init__(self, loads: list[list[np.ndarray]], wb: int, n_buckets: int, seed: int):
        self.loads = loads
        keys = np.concatenate([x[1] for x in loads])
        self.words, self.at = np.unique(keys, return_inverse=True)
        total = lambda k: np.bincount(self.at, weights=np.concatenate([x[k] for x in loads]), minlength=len(self.words)).astype(np.int64)
        self.c, self.customers = total(2), total(3)
        self.v = int((self.c > 0).sum())
        # the tables of the other words' buckets are about as many as here
        group = np.zeros(len(self.words), np.int64)
        uniform = np.full(len(self.words), 1.0 / (self.v * n_buckets + 1))
        _, self.tables = gibbs(self.customers, uniform, group, 1, np.array([self.v * (n_buckets - 1.0)]), ROOT_DISCOUNT, ROOT_STRENGTH, _rng(seed, 2, wb), BURN, SWEEPS)
        self.contexts, place = np.unique(np.concatenate([x[4] for x in loads]), return_inverse=True)
        self.place = place
        self.c_u, self.t_u = (np.bincount(place, weights=np.concatenate([x[k] for x in loads]), minlength=len(self.contexts)) for k in (5, 6))

    def spread(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each load, its spread contexts' customers in all buckets, and their tables in the others, by what each bucket last told."""
        at = 0
        for load in self.loads:
            mine = self.place[at : at + len(load[4])]
            at += len(load[4])
            yield self.c_u[mine], self.t_u[mine] - load[6]


def score_texts(docs: DataFrame, held_out: str = "false", sweeps: int = SWEEPS, seed: int = SEED, rounds: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row per row of docs (doc_id long, text), all texts whole.

    held_out: an SQL condition of rows that the model doesn't learn from; null counts as false. score is the log10 probability of
    the text under the model, its tables averaged over the sweeps; base_score that of add-one unigrams. Null and empty texts are
    one end token; rows that repeat an id are scored each. A corpus without training rows scores by the uniform base. rounds: how
    often contexts are seated anew on the parent's last state before scoring.
    """
    spark = _frames.ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(2, -(-total // BUCKET_BYTES))
    hot = _hot_contexts(rows, total, n)
    hold = spark.sparkContext.broadcast(hot)
    dealt = rows.mapInArrow(_emit(n, hot), "b int, load binary")

    def first(group: pa.Table) -> pa.Table:
        b = group.column("b")[0].as_py()
        p = Pieces(_loads(group))
        # no counts of other buckets yet: the words of this one stand for all
        local = (p.c_w[p.w] + 1.0) / (p.c_w.sum() + len(p.words) + 1.0)
        t, _ = gibbs(p.c, local, p.u, len(p.contexts), np.zeros(len(p.contexts)), DISCOUNT, STRENGTH, _rng(seed, 1, b), BURN, 1)
        return _request(p, b, t, hold.value, n)

    def counts(group: pa.Table) -> pa.Table:
        x = Parent(_loads(group), group.column("wb")[0].as_py(), n, seed)
        return pa.table({"n": [int(x.c.sum())], "v": [x.v], "customers": [int(x.customers.sum())], "tables": [float(x.tables.sum())]})

    def reply(group: pa.Table, sums: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"b": pa.array([], pa.int32()), "load": pa.array([], pa.binary())})
        wb = group.column("wb")[0].as_py()
        x = Parent(_loads(group), wb, n, seed)
        s = {k: sums.column(k)[0].as_py() for k in ("n", "v", "customers", "tables")}
        p0 = (x.customers - ROOT_DISCOUNT * x.tables + (ROOT_STRENGTH + ROOT_DISCOUNT * s["tables"]) / (s["v"] + 1)) / (ROOT_STRENGTH + s["customers"])
        keys, loads, at = [], [], 0
        for load, (c_u, outside) in zip(x.loads, x.spread()):
            mine = x.at[at : at + len(load[1])]
            at += len(load[1])
            keys.append(int(load[0][0]))
            loads.append(_pack(np.array([wb, s["n"], s["v"]], np.int64), x.c[mine].astype(np.uint32) if s["n"] < 1 << 32 else x.c[mine], p0[mine], c_u, outside))
        return pa.table({"b": pa.array(keys, pa.int32()), "load": pa.array(loads, pa.binary())})

    def answered(group: pa.Table, replies: pa.Table) -> tuple[Pieces, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
        """(pieces, counts of the words, their parent probability, customers and outside tables of the contexts, N, V)."""
        p = Pieces(_loads(group))
        at = _bucket(p.words, n)
        order = np.argsort(at, kind="stable")
        h = _hot_in(p.contexts, hold.value)
        hb = _bucket(p.contexts[h], n)
        got = {int(x[0][0]): x for x in _loads(replies)}
        count, p0 = np.zeros(len(p.words), np.int64), np.zeros(len(p.words))
        c_u, elsewhere = p.c_u.copy(), np.zeros(len(p.contexts))
        cuts = np.searchsorted(at[order], np.arange(n + 1))
        big_n = big_v = 0
        for k, x in got.items():
            mine = order[cuts[k] : cuts[k + 1]]
            count[mine], p0[mine] = x[1], x[2]
            c_u[h[hb == k]], elsewhere[h[hb == k]] = x[3], x[4]
            big_n, big_v = int(x[0][1]), int(x[0][2])
        return p, count, p0, c_u, elsewhere, big_n, big_v

    def seated(p: Pieces, b: int, p0: np.ndarray, elsewhere: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _hot_in(p.contexts, hold.value)
        extra = np.zeros(len(p.contexts))
        if len(h):
            extra[h] = elsewhere[h]
        last, mean = gibbs(p.c, p0[p.w], p.u, len(p.contexts), extra, DISCOUNT, STRENGTH, _rng(seed, 3 + step, b), BURN, sweeps)
        return last, mean, extra

    def again(step: int):
        def run(group: pa.Table, replies: pa.Table) -> pa.Table:
            b = group.column("b")[0].as_py()
            p, _, p0, _, elsewhere, _, _ = answered(group, replies)
            last, _, _ = seated(p, b, p0, elsewhere, step)
            return _request(p, b, last, hold.value, n)

        return run

    def score(group: pa.Table, replies: pa.Table) -> pa.Table:
        b = group.column("b")[0].as_py()
        p, count, p0, c_u, elsewhere, big_n, big_v = answered(group, replies)
        _, mean, extra = seated(p, b, p0, elsewhere, 0)
        t_u = np.bincount(p.u, weights=mean, minlength=len(p.contexts)) + extra
        whole = STRENGTH + c_u[p.u]
        chance = (np.maximum(p.c - DISCOUNT * mean, 0) + (STRENGTH + DISCOUNT * t_u[p.u]) * p0[p.w]) / whole
        value = np.log10(chance)
        plain = np.log10(count + 1.0)[p.w]
        known = (count > 0)[p.w]
        homes, loads, at = [], [], 0
        for piece, _, _, pw, amount, doc, train, *info in p.loads:
            pair = np.repeat(p.pair[at : at + len(pw)], amount)
            at += len(pw)
            m = len(train)
            sums = [np.bincount(doc, weights=x[pair], minlength=m) for x in (value, plain, known)]
            here = np.flatnonzero(np.bincount(doc, minlength=m))
            homes.append(int(piece[0]) * 2654435761 % n)
            some = [here.astype(np.uint16 if m <= 1 << 16 else np.uint32), sums[0][here].astype(np.float32), sums[1][here], sums[2][here].astype(np.uint32)]
            loads.append(_pack(np.array([int(piece[0]), big_n, big_v, m], np.int64), *some, *([train, *info] if info else [])))
        return pa.table({"home": pa.array(homes, pa.int32()), "load": pa.array(loads, pa.binary())})

    def final(group: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for x in _loads(group):
            by.setdefault(int(x[0][0]), []).append(x)
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        valid = []
        for _, many in sorted(by.items()):
            m = int(many[0][0][3])
            sums = np.zeros((3, m))
            for x in many:
                for k in range(3):
                    sums[k, x[1]] += x[2 + k]
            info = next(x for x in many if len(x) > 5)
            train, ids, is_known, n_tokens = info[5:9]
            big_n, big_v = int(info[0][1]), int(info[0][2])
            valid.append(is_known.astype(bool))
            tokens_ = n_tokens.astype(np.int64)
            for c, v in zip(cols, (ids, train == 0, tokens_, np.rint(sums[2]).astype(np.int64), np.full(m, big_n, np.int64), sums[1] - tokens_ * math.log10(big_n + big_v + 1), sums[0])):
                c.append(v)
        made = [np.concatenate(c) for c in cols]
        made[0] = pa.array(made[0], pa.int64(), mask=~np.concatenate(valid))
        return pa.table(dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), made)))

    ask = "wb int, load binary"
    requests = dealt.groupBy("b").applyInArrow(first, ask)
    for step in range(rounds, -1, -1):
        sums = requests.groupBy("wb").applyInArrow(counts, "n long, v long, customers long, tables double").agg(*[F.sum(c).alias(c) for c in ("n", "v", "customers", "tables")])
        told = sums.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("wb"), *sums.columns)
        replies = requests.groupBy("wb").cogroup(told.groupBy("wb")).applyInArrow(reply, "b int, load binary")
        both = dealt.groupBy("b").cogroup(replies.groupBy("b"))
        if step:
            requests = both.applyInArrow(again(step), ask)
    scored = both.applyInArrow(score, "home int, load binary")
    return scored.groupBy("home").applyInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _hot_contexts(rows: DataFrame, total: int, n: int) -> np.ndarray:
    """Hashes of contexts that would overfill a bucket, sorted; a few for each bucket at most."""
    most = 4 * n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in _text.chunks(batch.column(0)):
                w, _ = tokens(buf, offsets)
                # every row's end stands for its beginning, the context of its first word
                u, c = np.unique(np.where(w == _END, _BEGIN, w), return_counts=True)
                top = np.argsort(-c, kind="stable")[:most]
                yield pa.RecordBatch.from_arrays([pa.array(u[top].view(np.int64)), pa.array(c[top]), pa.array(np.where(np.arange(len(top)) == 0, len(w), 0))], names=["u", "c", "all"])

    some = rows.select("text").sample(min(1.0, HOT_SAMPLE / max(total, 1)), SEED)
    found = some.mapInArrow(count, "u long, c long, all long")
    found = found.groupBy("u").agg(F.sum("c").alias("c"), F.sum("all").alias("all")).orderBy(F.desc("c")).limit(most).collect()
    seen = some.mapInArrow(count, "u long, c long, all long").agg(F.sum("all")).head()[0] if found else 0
    return np.sort(np.array([r["u"] for r in found if r["c"] > seen * HOT / n], np.int64).view(np.uint64))


def op5_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that aren't held out."""
    docs = _frames.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, "crc32(CAST(doc_id AS STRING)) % 7 = 2")


QUERIES = {"op5_hpylm": op5_hpylm}
SQL: dict[str, str] = {}
