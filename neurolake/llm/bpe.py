"""BPE by automaton: merges compiled one gadget at a time, words encoded by table-driven transitions (operator 9).

State of the automaton after a token: which tokens may follow it. Compiling merge (u, v) -> uv adds one state, the
copy of u's state without its v arc, redirects all u arcs to it, and gives uv the arcs that v had. So every state is
its parent less one arc, and arc (state, t) is absent exactly if some ancestor lost t, or lost the left part of t
before t itself was made. Accepted token sequences are the ones that BPE produces; a text has exactly one.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from neurolake.llm import _frames

#: the pre-split pattern of the vocabulary file is read from it; words kept by a worker in each of two generations
CACHE_WORDS = 120_000


#: white space to Python's str.split, symbols to the vocabulary's pattern
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself where printable, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """The deterministic automaton of a merge list over given base symbols."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        size = max(vocab.values()) + 1
        self.born = [-1] * size  # the merge that made a token; -1: a base symbol
        self.left = [-1] * size
        self.state = [0] * size  # where all arcs of a token lead
        self.parent, self.lost, self.depth = [0], [-1], [0]
        made = set()
        self.losers: dict[int, list[int]] = {}  # token -> states that lost it, in order of making
        for k, (a, b) in enumerate(merges):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            if t in made:
                raise ValueError("two merges make one token")
            made.add(t)
            self.gadget(k, u, v, t)
        self._intervals()
        self._arcs: dict[int, bool] = {}
        # a merge whose parts can't meet makes a token without arcs
        dead = set()
        for k, (a, b) in enumerate(merges):
            if vocab[a] in dead or vocab[b] in dead or not self._arc(self.parent[k + 1], vocab[b]):
                dead.add(vocab[a + b])
        #: token of each spelling; -1: only the beginning of some
        self.spelled = {w[:i]: -1 for w in vocab for i in range(1, len(w))} | {w: t for w, t in vocab.items() if t not in dead}

    def gadget(self, k: int, u: int, v: int, t: int) -> None:
        """Adds merge k: (u, v) -> t."""
        new = len(self.parent)
        self.parent.append(self.state[u])
        self.lost.append(v)
        self.losers.setdefault(v, []).append(new)
        self.born[t], self.left[t] = k, u
        self.state[t] = self.state[v]
        self.state[u] = new

    def _intervals(self) -> None:
        """Numbers the state tree so that ancestors are intervals."""
        n = len(self.parent)
        below = [0] * n
        for s in range(n - 1, 0, -1):
            below[self.parent[s]] += 1 + below[s]
        at, self.enter = [1] * n, [0] * n
        for s in range(1, n):  # parents come first
            p = self.parent[s]
            self.enter[s] = self.enter[p] + at[p]
            at[p] += 1 + below[s]
        self.leave = [e + b for e, b in zip(self.enter, below)]
        self.by_token = {}
        for t, states in self.losers.items():
            states.sort(key=lambda s: self.enter[s])
            self.by_token[t] = ([self.enter[s] for s in states], states)

    def arc(self, s: int, t: int) -> bool:
        """Whether token t may follow in state s. Answers are kept in the transition table."""
        key = s << 20 | t
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) > 500_000:
                self._arcs.clear()
            known = self._arcs[key] = self._arc(s, t)
        return known

    def _arc(self, s: int, t: int) -> bool:
        e, bound = self.enter[s], len(self.parent)
        while t >= 0:
            enters, states = self.by_token.get(t, ((), ()))
            lo, hi = 0, len(enters)
            while lo < hi:
                mid = (lo + hi) // 2
                if enters[mid] <= e:
                    lo = mid + 1
                else:
                    hi = mid
            # states that lost t are apart from one another, so only the last one that begins before s can be an ancestor
            if lo and self.leave[states[lo - 1]] >= e and states[lo - 1] - 1 <= bound:
                return False
            bound, t = self.born[t], self.left[t]
        return True

    def encode(self, text: str, end: str = "") -> list[int]:
        """The only path whose arcs spell the text, a symbol a character, the last one with the word end; longest arcs tried first.

        A prefix has one encoding, so a position is entered once: if no path leads on from it, it is given up for good.
        """
        n = len(text)
        text, tail = text[:-1], text[-1] + end
        spelled, state, arc = self.spelled, self.state, self.arc

        whole = spelled.get(text + tail, -1)
        if whole >= 0:
            return [whole]
        entered = bytearray(n + 1)
        path: list[int] = []
        stack: list[list[tuple[int, int]]] = []
        j, came = 0, 0
        while True:
            # all tokens spelled from j on
            ahead = []
            for i in range(j + 1, n):
                t = spelled.get(text[j:i])
                if t is None:
                    break
                if t >= 0:
                    ahead.append((i, t))
            else:
                t = spelled.get(text[j:] + tail, -1)
                if t >= 0:
                    ahead.append((n, t))
            stack.append(ahead)
            while True:
                if not ahead:
                    stack.pop()
                    if not stack:
                        raise ValueError("a symbol is not in the vocabulary")
                    path.pop()
                    ahead = stack[-1]
                    came = state[path[-1]] if path else 0
                    continue
                i, t = ahead.pop()
                if not entered[i] and (not path or arc(came, t)):
                    break
            entered[i] = 1
            path.append(t)
            if i == n:
                return path
            j, came = i, state[t]


class WordBPE:
    """Encoder and decoder of a byte-level vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = dict(enumerate(byte_symbols()))
        # two generations, so that frequent words stay
        self.kept: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}
        self.runs: dict[str, tuple[str, str, int]] = {}
        self.old_runs: dict[str, tuple[str, str, int]] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC, lower case code point by code point. White space needs no folding, as the split drops it."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def word_ids(self, word: str) -> list[int]:
        if not (word.isascii() and word.isprintable()):  # printable ASCII stands for itself
            word = word.encode().decode("latin-1").translate(self.symbols)
        return self.automaton.encode(word, self.end)

    def word(self, word: str) -> tuple[str, str, int]:
        """(ids in decimal, labels, how many), joined by spaces."""
        got = self.kept.get(word)
        if got is not None:
            return got
        got = self.old.get(word)
        if got is not None:
            self.kept[word] = got
        else:
            if len(self.kept) >= CACHE_WORDS:
                self.kept, self.old = {}, self.kept
            ids = [self.special[word]] if word in self.special else self.word_ids(word)
            got = self.kept[word] = (" ".join(map(str, ids)), " ".join(self.label[i] for i in ids), len(ids))
        return got

    def pieces(self, text: str) -> list[str]:
        """Words of the text in order; special tokens in it stand for themselves."""
        if self.cut is None or "<" not in text or not self.cut.search(text):
            return self.split.findall(self.normal(text))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            else:
                out += self.split.findall(self.normal(part))
        return out

    def run(self, text: str) -> tuple[str, str, int]:
        """word() of a run without white space, or of any text, as one."""
        got = [self.word(w) for w in self.pieces(text)]
        if len(got) != 1:
            got = [(" ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got]))]
        if len(self.runs) >= CACHE_WORDS:
            self.runs, self.old_runs = {}, self.runs
        self.runs[text] = got[0]
        return got[0]

    def text_runs(self, text: str) -> list[tuple[str, str, int]]:
        """Encodings of the runs between white space, which no word crosses. Frequent runs are looked up, not encoded."""
        if _ODD_SPACE.search(text) or (self.cut is not None and "<" in text and self.cut.search(text)):
            return [self.word(w) for w in self.pieces(text)]
        runs, old, run = self.runs.get, self.old_runs, self.run
        out = []
        for w in text.split():
            got = runs(w)
            if got is None:
                got = old.get(w)
                if got is None:
                    got = run(w)
                    runs, old = self.runs.get, self.old_runs
                else:
                    self.runs[w] = got
            out.append(got)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for g in self.text_runs(text) for i in g[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The arc labels in order, as a decoder without rules joins them."""
        return " ".join([self.label[i] for i in ids])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        got = self.text_runs(text or "")
        ids, labels = " ".join([g[0] for g in got if g[2]]), " ".join([g[1] for g in got if g[2]])
        return sum([g[2] for g in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(labels.encode()).hexdigest()


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    _frames.keep("bpe", load.cache_clear)
    return WordBPE(path)


def vocabulary() -> str:
    """The default vocabulary file; it belongs to an installed package, on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """docs with ids (array<int>): the tokens of the whole text. Null is encoded as the empty text: no tokens."""

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = load(path or vocabulary())
        return {"ids": pa.array([bpe.encode(t or "") for t in _frames.text_column(batch, column).to_pylist()], pa.list_(pa.int32()))}

    return _frames.add_columns(docs, [("ids", "array<int>")], add, keeps="bpe")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with decoded (string), of ids; null ids decode to the empty text."""

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = load(path or vocabulary())
        return {"decoded": pa.array([bpe.decode(i or []) for i in _frames.text_column(batch, "ids").to_pylist()], pa.string())}

    return _frames.add_columns(encoded, [("decoded", "string")], add, keeps="bpe")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoding and decoding word by word, without keeping the ids."""

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        bpe = load(path or vocabulary())
        got = [bpe.digest(t) for t in _frames.text_column(batch).to_pylist()]
        return {"n_tokens": pa.array([g[0] for g in got], pa.int64()), "ids_sha256": pa.array([g[1] for g in got], pa.string()), "decoded_sha256": pa.array([g[2] for g in got], pa.string())}

    return _frames.add_columns(docs.select("doc_id", "text"), [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], add, ["doc_id"], "bpe")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document."""
    return digests(_frames.table(spark, sf_dir, "documents"))


QUERIES = {"op9_bpe": op9_bpe}
SQL: dict[str, str] = {}
