"""SentencePiece encoding and decoding, with giant documents split into chunks.

The method named for this operator, a max-plus scan, solves *unigram* models: a chunk's
transfer matrix holds the best score from every boundary state before it to every state
after it; matrices combine associatively; each chunk is then traced back by itself.
``MaxPlusScan`` does that for unigram models and matches the library. The public model
at hand is a *BPE* model: its pieces come from merges in rank order, which no sum of
piece scores expresses. There the library's own encoder is used on each chunk, and chunks
are cut only between a non-space character and a space. No piece of the model holds such
a place (checked when the model is read), so no merge crosses it: the boundary has one
state, its transfer matrix is 1 x 1, and chunks are independent and exact.

Defined results: a null text has null ids and a null decoded text; an empty text has no
ids; a text without a cutting place stays one chunk; repeated rows are encoded each;
further columns stay, but those named like a result are replaced; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.llm.tokens import release

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What an unknown character costs below the least piece score, as the library has it.
UNKNOWN_PENALTY = 10.0
#: A chunk is more than the space it begins with (the library encodes an empty rest to nothing),
#: and U+2581 before a space is a space to the model.
_CUT = re.compile(rf"(?<=[^ {SPACE}]) (?!\Z)")


@lru_cache(maxsize=4)
def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _proto(model: bytes):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    return proto


def is_unigram(model: bytes) -> bool:
    return _proto(model).trainer_spec.model_type == 1


def check_cuts(model: bytes) -> None:
    """Raise if texts can't be cut between a non-space and a space under this model."""
    proto = _proto(model)
    spec = proto.normalizer_spec
    if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("chunking needs an identity normalizer that keeps white space and adds a prefix")
    if any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type == 1):
        raise ValueError("a piece of this model reaches over a word boundary")


def split(text: str, size: int) -> list[str]:
    """text in chunks of about size characters, each after the first beginning with the space it is cut at."""
    out, at = [], 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class MaxPlusScan:
    """Viterbi of a unigram model over chunks: transfer, combine, trace.

    A boundary's state is how many characters the last piece boundary lies before it.
    """

    def __init__(self, model: bytes):
        proto = _proto(model)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.score = {p.piece: p.score for p in proto.pieces if p.type in (1, 4)}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.unknown_score = min(self.score.values()) - UNKNOWN_PENALTY
        self.reach = max(len(p) for p in self.score)
        self.fallback = proto.trainer_spec.byte_fallback

    def normal(self, text: str) -> str:
        return (SPACE + text.replace(" ", SPACE)) if text else ""

    def _edge(self, piece: str) -> float | None:
        found = self.score.get(piece)
        return self.unknown_score if found is None and len(piece) == 1 else found

    def _run(self, before: str, chunk: str, entry: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Best scores at nodes before-reach .. end of before + chunk, for each row of entry, and where they come from.

        entry: (rows, reach) scores of boundary states; before: the reach - 1 characters (at most) before the chunk.
        """
        text, m = before + chunk, len(before)
        best = np.full((len(text) + 1, len(entry)), -np.inf)
        back = [np.full(len(entry), -1)] * (len(text) + 1)
        for o in range(min(self.reach, m + 1)):
            best[m - o] = entry[:, o]
        for end in range(m + 1, len(text) + 1):
            come = np.full(len(entry), -1)
            for start in range(max(0, end - self.reach), end):  # the first of equals stays: the longest piece
                w = self._edge(text[start:end])
                if w is not None:
                    better = best[start] + w > best[end]
                    best[end] = np.where(better, best[start] + w, best[end])
                    come = np.where(better, start, come)
            back[end] = come
        return best, back

    def _exit(self, best: np.ndarray, n: int) -> np.ndarray:
        """Scores by exit state; nodes of the chunk itself only."""
        out = np.full((best.shape[1], self.reach), -np.inf)
        for o in range(min(self.reach, n)):
            out[:, o] = best[len(best) - 1 - o]
        return out

    def transfer(self, before: str, chunk: str) -> np.ndarray:
        """(reach, reach) best scores from entry states to exit states."""
        entry = np.full((self.reach, self.reach), -np.inf)
        np.fill_diagonal(entry, 0.0)
        best, _ = self._run(before, chunk, entry)
        return self._exit(best, len(chunk))

    @staticmethod
    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The max-plus product: associative, so chunks can be combined in any grouping."""
        return (a[:, :, None] + b[None, :, :]).max(1)

    def entries(self, matrices: list[np.ndarray]) -> list[np.ndarray]:
        """Scores of the entry states of every chunk: a prefix scan."""
        now = np.full((1, self.reach), -np.inf)
        now[0, 0] = 0.0
        out = []
        for t in matrices:
            out.append(now[0])
            now = self.combine(now, t)
        return out

    def trace(self, before: str, chunk: str, entry: np.ndarray) -> list[tuple[int, list[str]]]:
        """For each exit state: the entry state it comes from and the pieces that end in the chunk."""
        text, m = before + chunk, len(before)
        _, back = self._run(before, chunk, entry[None, :])
        out = []
        for o in range(self.reach):
            at, pieces = len(text) - o, []
            while at > m and back[at][0] >= 0:
                start = int(back[at][0])
                pieces.append(text[start:at])
                at = start
            out.append((m - at if at <= m else -1, pieces[::-1]))
        return out

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.fallback:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def chunks(self, text: str, size: int) -> list[tuple[str, str]]:
        """(characters before, chunk) pairs of a normalized text; chunks of reach characters at least."""
        size = max(size, self.reach)
        n = max(1, len(text) // size)
        edges = [len(text) * i // n for i in range(n + 1)]
        return [(text[max(0, a - self.reach + 1) : a], text[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, text: str, size: int = 4096) -> list[int]:
        """One text through all steps, as the distributed form does them."""
        parts = self.chunks(self.normal(text), size)
        if not text:
            return []
        entries = self.entries([self.transfer(*p) for p in parts])
        traces = [self.trace(*p, e) for p, e in zip(parts, entries, strict=True)]
        return self.to_ids(join_traces(traces))


def join_traces(traces: list[list[tuple[int, list[str]]]]) -> list[str]:
    """Pieces of a text: exit states are found from the last chunk to the first by table look-ups."""
    state, out = 0, []
    for t in reversed(traces):
        state, pieces = t[state]
        out.append(pieces)
    return [p for pieces in reversed(out) for p in pieces]


def encode(docs: DataFrame, *, model_path: str = MODEL, column: str = "text", giant_chars: int = 65_536) -> DataFrame:
    """docs with ``ids``: the model's pieces of the whole text.

    Texts of more than giant_chars characters travel as chunks of about that size, dealt
    out over the cluster; the model's bytes (0.5 MB, whatever the input) go with the task.
    """
    model = read_model(model_path)
    unigram = is_unigram(model)
    if not unigram:
        check_cuts(model)
    docs = docs.drop("ids")
    names, schema = docs.columns, docs.schema
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model)
        for batch in batches:
            for i in range(0, len(batch), 256):
                rows = batch.slice(i, 256)
                ids = [None if t is None else sp.encode(t) for t in rows[column].to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])
        release()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = MaxPlusScan(model) if unigram else None
        for batch in batches:
            for uid, text in zip(batch["__uid"].to_pylist(), batch[column].to_pylist(), strict=True):
                parts = scan.chunks(scan.normal(text), giant_chars) if scan else [("", c) for c in split(text, giant_chars)]
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid] * len(some)), pa.array(range(i, i + len(some)), pa.int32()), pa.array([b for b, _ in some], pa.string()), pa.array([c for _, c in some], pa.string())],
                        names=["__uid", "no", "before", "chunk"],
                    )

    def bpe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model)
        for batch in batches:
            # the library adds the leading space itself, so the one a chunk begins with is left to it
            ids = [sp.encode(c[1:] if no else c) for no, c in zip(batch["no"].to_pylist(), batch["chunk"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["__uid"], batch["no"], pa.array(ids, pa.list_(pa.int32()))], names=["__uid", "no", "part"])

    is_giant = F.coalesce(F.length(column) > giant_chars, F.lit(False))
    usual = docs.where(~is_giant).mapInArrow(whole, f"{typed}, ids array<int>")
    giant = docs.where(is_giant).withColumn("__uid", F.xxhash64(*names))
    # equal giant rows share a uid and are encoded once
    parts = giant.select("__uid", column).dropDuplicates(["__uid"]).mapInArrow(cut_up, "__uid long, no int, before string, chunk string")
    if unigram:
        coded = _scan(parts, model)
    else:
        dealt = parts.repartition("__uid", "no")
        coded = dealt.mapInArrow(bpe, "__uid long, no int, part array<int>")
        ordered = F.sort_array(F.collect_list(F.struct("no", "part")))
        coded = coded.groupBy("__uid").agg(F.flatten(F.transform(ordered, lambda x: x["part"])).alias("ids"))
    return usual.union(giant.join(coded, "__uid").select(*names, "ids"))


def _scan(parts: DataFrame, model: bytes) -> DataFrame:
    """(__uid, no, before, chunk) to (__uid, ids) for unigram models: transfer, scan, trace, join."""
    dealt = parts.repartition("__uid", "no")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = MaxPlusScan(model)
        for batch in batches:
            made = [scan.transfer(b, c).tobytes() for b, c in zip(batch["before"].to_pylist(), batch["chunk"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["__uid"], batch["no"], pa.array(made, pa.binary())], names=["__uid", "no", "t"])

    def prefix(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        scan = MaxPlusScan(model)
        entries = scan.entries([np.frombuffer(t).reshape(scan.reach, scan.reach) for t in table["t"].to_pylist()])
        return pa.Table.from_arrays([table["__uid"], table["no"], pa.array([e.tobytes() for e in entries], pa.binary())], names=["__uid", "no", "entry"])

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = MaxPlusScan(model)
        for batch in batches:
            rows = zip(batch["before"].to_pylist(), batch["chunk"].to_pylist(), batch["entry"].to_pylist(), strict=True)
            found = [scan.trace(b, c, np.frombuffer(e)) for b, c, e in rows]
            come = [[s for s, _ in t] for t in found]
            ids = [[scan.to_ids(p) for _, p in t] for t in found]
            yield pa.RecordBatch.from_arrays(
                [batch["__uid"], batch["no"], pa.array(come, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.list_(pa.int32())))], names=["__uid", "no", "come", "ids"]
            )

    made = dealt.mapInArrow(transfers, "__uid long, no int, t binary")
    entries = made.groupBy("__uid").applyInArrow(prefix, "__uid long, no int, entry binary")
    found = parts.join(entries, ["__uid", "no"]).select("__uid", "no", "before", "chunk", "entry")
    found = found.mapInArrow(traces, "__uid long, no int, come array<int>, ids array<array<int>>")
    back = F.sort_array(F.collect_list(F.struct((-F.col("no")).alias("no"), "come", "ids")))
    walk = F.aggregate(
        back,
        F.struct(F.lit(0).alias("state"), F.array().cast("array<array<int>>").alias("parts")),
        lambda a, x: F.struct(F.get(x["come"], a["state"]).alias("state"), F.concat(F.array(F.get(x["ids"], a["state"])), a["parts"]).alias("parts")),
    )
    return found.groupBy("__uid").agg(F.flatten(walk["parts"]).alias("ids"))


def decode(docs: DataFrame, *, model_path: str = MODEL, column: str = "ids") -> DataFrame:
    """docs with ``decoded``: the text of the ids. Exact but for U+2581, which is the model's own space."""
    model = read_model(model_path)
    docs = docs.drop("decoded")
    names = docs.columns
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(model)
        for batch in batches:
            for i in range(0, len(batch), 256):
                rows = batch.slice(i, 256)
                text = [None if x is None else sp.decode(x) for x in rows[column].to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(text, pa.string())], names=[*names, "decoded"])
        release()

    return docs.mapInArrow(run, f"{typed}, decoded string")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """docs with ``ids``, ``n_tokens`` and ``exact``: whether the decoded ids are the text again."""
    path = {"model_path": options["model_path"]} if "model_path" in options else {}
    coded = decode(encode(docs, **options), **path)
    same = F.col("decoded").eqNullSafe(F.replace("text", F.lit(SPACE), F.lit(" ")))
    return coded.withColumns({"n_tokens": F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long"), "exact": same}).drop("decoded")
