"""LM scoring: a weighted backoff automaton over smoothed n-grams.

States are n-grams (contexts) seen in training; state h has an arc for each word seen
after it and a failure arc to h without its first word. With c the training counts and
k the strength of an order,

    arc      (c(hw) + k p(w | h')) / (c(h) + k)
    failure  k / (c(h) + k)            times the weight found at h'

so p(. | h) sums to one. The last state's arcs are unigrams with an absolute discount D =
n1 / (n1 + 2 n2) (n1, n2: words seen once and twice): (c - D) / N for a seen word, and
the discounted mass D V / N for the one class of all unseen words. A text is read once from left to right: the
carried state is the longest seen context, failure arcs are followed until an arc for
the word exists, and log10 weights add up.

How it is distributed: texts are packed into chunks of a bounded size, in the order they
are read, so rows that are alike (or all null) are spread like others. A chunk sends its
distinct n-grams, by 64-bit names in every order, with its training counts to hash
buckets and gets back the whole corpus's counts for them. From these it builds exactly the
states, arcs and failure arcs that its own texts can reach, and traverses them. Model and
texts grow without any table that must fit in one place; nothing is pruned, capped or
broadcast, and a score depends on the corpus alone, not on how it is partitioned.

Defined results: a null text is empty and scores its end token alone; a null id is
learned from; repeated rows count as often as they occur; a very long text is a chunk of
its own, linear in its words; further columns are not read; an empty table gives an empty
table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm import tokens as tk
from lobspark.llm.chunks import pack_chunks, unpacked
from lobspark.llm.common import partitions

_GRAM = np.uint64(0xD6E8FEB86659FD93)


def discount(once: int, twice: int) -> float:
    """Taken from every seen word's count; held away from 0 and 1 where counts are few."""
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5


def unigram(count, total: int, types: int, d: float):
    """Probability of a word by its training count; 0 is the class of unseen words."""
    if not total:
        return count * 0 + 1.0
    return np.where(count > 0, count - d, d * types) / total


class BackoffAutomaton:
    """The automaton for a corpus that fits in memory: explicit states, arcs and failure arcs."""

    def __init__(self, texts: list[list[str]], strengths: tuple[float, ...]):
        self.strengths = strengths
        order = len(strengths) + 1
        count: dict[tuple, int] = {}
        for text in texts:
            seq = ["<begin>", *text, "<end>"]
            for i in range(1, len(seq)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        g = tuple(seq[i - n + 1 : i + 1])
                        count[g] = count.get(g, 0) + 1
        count[("<begin>",)] = len(texts)
        self.count = count
        self.total = sum(c for g, c in count.items() if len(g) == 1 and g != ("<begin>",))
        seen = [c for g, c in count.items() if len(g) == 1 and g != ("<begin>",)]
        self.types = len(seen)
        self.discount = discount(seen.count(1), seen.count(2))

    def failure(self, state: tuple) -> tuple[tuple, float]:
        k = self.strengths[len(state) - 1]
        return state[1:], k / (self.count.get(state, 0) + k)

    def arc(self, state: tuple, word: str) -> float | None:
        seen = self.count.get((*state, word), 0)
        if not state:
            return unigram(seen, self.total, self.types, self.discount)
        if not seen:
            return None
        k = self.strengths[len(state) - 1]
        return (seen + k * self.probability(state[1:], word)) / (self.count[state] + k)

    def probability(self, state: tuple, word: str) -> float:
        weight = 1.0
        while (p := self.arc(state, word)) is None:
            state, w = self.failure(state)
            weight *= w
        return weight * p

    def score(self, text: list[str]) -> float:
        state, total = ("<begin>",), 0.0
        for word in [*text, "<end>"]:
            total += math.log10(self.probability(state, word))
            state = (*state, word)[-len(self.strengths) :]
            while state and state not in self.count:
                state = state[1:]
        return total


def _grams(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """n-gram hash ending at each position by order (0 where there is none), ends and positions of texts.

    A text is BEGIN, its words, END; an n-gram does not reach over BEGIN.
    """
    hashes, upto = tk.token_hashes(table["text"])
    n = len(upto) - 1
    size = np.diff(upto) + 2
    first = np.concatenate([[0], np.cumsum(size)])
    seq = np.empty(first[-1], np.uint64)
    inside = np.ones(len(seq), bool)
    inside[first[:-1]] = inside[first[1:] - 1] = False
    seq[inside] = hashes
    seq[first[:-1]], seq[first[1:] - 1] = tk.BEGIN, tk.END
    depth = np.minimum(np.arange(len(seq)) - np.repeat(first[:-1], size), 127).astype(np.int8)
    grams = [seq]
    for k in range(1, order):
        longer = np.zeros(len(seq), np.uint64)
        longer[1:] = tk.mix(grams[-1][:-1] * _GRAM + seq[1:])
        longer[depth < k] = 0
        grams.append(longer)
    return grams, first, depth if n else np.empty(0, np.int64)


def _counted(names: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, positions' indexes among them, their training counts. 0 is no n-gram."""
    keys, where = np.unique(names, return_inverse=True)
    counts = np.bincount(where, weights, len(keys)).astype(np.int64)
    counts[keys == 0] = 0
    return keys, where if len(names) >= 2**31 else where.astype(np.int32), counts


class Automaton:
    """The part of the model that some texts reach: states, arcs and failure arcs as arrays.

    A state of k words is a distinct n-gram of k words with a count; so is an arc that leaves it,
    with one word more. level k of each list holds those of k words (0: the root).
    """

    def __init__(self, where: list[np.ndarray], depth: np.ndarray, total: list[np.ndarray], strengths, ends: tuple[int, int, int, int]):
        self.where, self.depth, self.total = where, depth, total
        n, v, once, twice = ends
        p = unigram(total[0], n, v, discount(once, twice))
        self.arc, self.fail = [np.log10(p)], [None]
        for k, s in enumerate(strengths, 1):
            # of each n-gram: the state it leaves and the n-gram one word shorter, known from any place it occurs at
            at = np.flatnonzero(depth >= k)
            leaves, shorter = np.zeros(len(total[k]), np.int64), np.zeros(len(total[k]), np.int64)
            leaves[where[k][at]], shorter[where[k][at]] = where[k - 1][at - 1], where[k - 1][at]
            context = total[k - 1][leaves]
            p = (total[k] + s * p[shorter]) / (context + s)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(s / (total[k - 1] + s)))

    def traverse(self) -> np.ndarray:
        """log10 weight of the step to each position; all texts are read at once, as the state before a step is known."""
        log = np.zeros(len(self.depth))
        waiting = np.flatnonzero(self.depth > 0)
        for k in range(len(self.arc) - 1, 0, -1):
            before = self.where[k - 1][waiting - 1]
            state = (self.depth[waiting] >= k) & (self.total[k - 1][before] > 0)  # the carried state has k words, or came to have
            taken = state & (self.total[k][self.where[k][waiting]] > 0)
            log[waiting[taken]] += self.arc[k][self.where[k][waiting[taken]]]
            down = state & ~taken
            log[waiting[down]] += self.fail[k][before[down]]
            waiting = waiting[~taken]
        log[waiting] += self.arc[0][self.where[0][waiting]]
        return log


#: Bits of a name that are sent as they are; the rest is sent as steps between sorted names.
LOW = 40


def _squeeze(raw: np.ndarray) -> bytes:
    data = raw.tobytes()
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unsqueeze(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True), kind)


def encode_names(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit names, about 5.6 bytes each where a million spread over all values."""
    high = (keys >> np.uint64(LOW)).astype(np.int64)
    step = np.diff(high, prepend=0)
    large = np.flatnonzero(step > 254)
    steps = _squeeze(np.minimum(step, 255).astype(np.uint8))
    rest = _squeeze(step[large].astype(np.int32))
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8].tobytes()
    return b"".join(len(x).to_bytes(4, "little") + x for x in (steps, rest, low))


def decode_names(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    step = _unsqueeze(parts[0], np.uint8).astype(np.int64)
    step[step == 255] = _unsqueeze(parts[1], np.int32)
    out = np.zeros((len(step), 8), np.uint8)
    out[:, : LOW // 8] = np.frombuffer(parts[2], np.uint8).reshape(-1, LOW // 8)
    return out.reshape(-1).view("<u8") + (np.cumsum(step).astype(np.uint64) << np.uint64(LOW))


def _pack(counts: np.ndarray) -> bytes:
    small, large = tk.pack(counts)
    small = _squeeze(np.frombuffer(small, np.uint8))
    return len(small).to_bytes(4, "little") + small + large


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    return tk.unpack(_unsqueeze(data[4 : 4 + n], np.uint8).tobytes(), data[4 + n :])


def _learned(table: pa.Table) -> np.ndarray:
    return ~np.asarray(table["held_out"].to_numpy(zero_copy_only=False), bool)


def score_texts(
    docs: DataFrame,
    held_out,
    *,
    strengths: tuple[float, ...] = (1024.0, 16.0),
    partition_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, train_types, base_score, score) of every row.

    held_out: Boolean column; rows where it isn't true are learned from. strengths: one
    for each order above the first, so their number plus one is the model's order.
    """
    spark, order = docs.sparkSession, len(strengths) + 1
    held = F.coalesce(held_out, F.lit(False))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), math.ceil(n_bytes / partition_bytes))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    dealt = pack_chunks(docs.select("doc_id", "text", held.alias("held_out"), size.alias("bytes")), partition_bytes)

    def counted(table: pa.Table):
        """(rows, first, depth, one (keys, where, counts) an order) of a chunk."""
        rows = unpacked(table)
        grams, first, depth = _grams(rows, order)
        weights = np.repeat(_learned(rows), np.diff(first)).astype(np.float64)
        return rows, first, depth, [_counted(g, weights) for g in grams]

    @tk.frugal
    def send(table: pa.Table) -> pa.Table:
        out, chunk = [], table["chunk"][0].as_py()
        for k, (keys, _, counts) in enumerate(counted(table)[3]):
            edges = np.searchsorted(tk.bucket_of(keys, n), np.arange(n + 1))
            for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if j > i or not k:  # of words every bucket is asked, for its sums
                    out.append((chunk, b, k, encode_names(keys[i:j]), _pack(counts[i:j])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), sent_types, strict=True)], names=sent_names)

    sent_names = ["chunk", "bucket", "k", "keys", "counts"]
    sent_types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    @tk.frugal
    def answer(table: pa.Table) -> pa.Table:
        keys = [decode_names(x) for x in table["keys"].to_pylist()]
        counts = np.concatenate([_unpack(x) for x in table["counts"].to_pylist()])
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, counts, len(every)).astype(np.int64)
        words = total[every != tk.BEGIN] if table["k"][0].as_py() == 0 else total[:0]
        back = [_pack(x) for x in np.split(total[where], np.cumsum([len(x) for x in keys])[:-1])]
        return pa.Table.from_arrays(
            [table["chunk"], table["bucket"], table["k"], pa.array(back, pa.binary()),
             *[pa.array([int(x.sum())] * len(keys), pa.int64()) for x in (words, words > 0, words == 1, words == 2)]],
            names=["chunk", "bucket", "k", "counts", "n", "v", "n1", "n2"],
        )

    @tk.frugal
    def read(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows, first, depth, parts = counted(table)
        told = answers.sort_by([("k", "ascending"), ("bucket", "ascending")])
        k_of, back = told["k"].to_numpy(), told["counts"].to_pylist()
        ends = tuple(sum(told[c].to_pylist()) for c in ("n", "v", "n1", "n2"))
        total = [np.concatenate([_unpack(back[i]) for i in np.flatnonzero(k_of == k)]) for k in range(order)]
        if any(len(t) != len(keys) for t, (keys, _, _) in zip(total, parts, strict=True)):
            raise RuntimeError("a chunk got counts for other n-grams than its own")
        automaton = Automaton([where for _, where, _ in parts], depth, total, strengths, ends)
        step, seen = depth > 0, total[0][parts[0][1]]
        base = np.log10((seen + 1) / (ends[0] + ends[1] + 1))
        add = lambda x: np.add.reduceat(x, first[:-1])
        return pa.Table.from_arrays(
            [rows["doc_id"], rows["held_out"], pa.array(np.diff(first) - 1), pa.array(add(((seen > 0) & step).astype(np.int64))),
             pa.array(np.full(len(rows), ends[0])), pa.array(np.full(len(rows), ends[1])),
             pa.array(add(np.where(step, base, 0.0))), pa.array(add(automaton.traverse()))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "train_types", "base_score", "score"],
        )

    sent = dealt.groupBy("chunk").applyInArrow(send, "chunk long, bucket int, k int, keys binary, counts binary")
    answers = sent.groupBy("bucket", "k").applyInArrow(
        answer, "chunk long, bucket int, k int, counts binary, n long, v long, n1 long, n2 long"
    )
    both = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(
        read,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, train_types long,"
        " base_score double, score double",
    )
