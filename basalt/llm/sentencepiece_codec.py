"""Merge-type SentencePiece vocabularies: encoding by a score-ordered agenda, and decoding.

A text is parted where no piece of the vocabulary can reach across. Each part is encoded once by
the agenda: the adjacent symbol pair of best score (leftmost on ties) merges first, and its new
neighbours join the agenda. Every encoded text is compared with the sentencepiece library's, in
the same Arrow batch.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import string
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import alone, slices, worker_cache

SPACE = "▁"
#: Parts of up to SHORT characters have a plain list for an agenda; the cost of a pair that is no piece.
SHORT, NEVER = 24, float("inf")
NORMAL, BYTE = 1, 6
#: Ranges of Latin and Cyrillic letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ӿ"


class _Parts(dict):
    """Ids of parts met. At most twice `limit` are held: those met lately, and those before."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.older = encode, limit, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.older.get(part)
        if ids is None:
            ids = self.encode(part)
        if len(part) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


def _breaks(pieces, lines: bool) -> str:
    """A pattern of the parts that no piece reaches across, given that none goes on before white space.

    lines: no longer piece has a line feed, so a break is sure there. It is sure too between a letter
    and an ASCII digit or sign that follows a letter in no piece.
    """
    inside = {p[i + 1] for p in pieces for i in range(len(p) - 1) if re.match(f"[{LETTERS}]", p[i])}
    signs = re.escape("".join(c for c in string.punctuation + string.digits if c not in inside))
    end = " \n" if lines else " "
    word = f" *[^{end}{LETTERS}]*[{LETTERS}]+"
    more = f"(?:[^{end}{LETTERS}{signs}][^{end}{LETTERS}]*[{LETTERS}]*)*"
    return f"{word}{more}| *[^{end}{LETTERS}]+| +" + ("|\n" if lines else "")


class Codec:
    """encode() and decode() of one model, given as the bytes of its file.

    Takes models of merge type with identity normalisation, a dummy prefix, escaped white space
    and byte fallback; others raise ValueError.
    """

    def __init__(self, model: bytes, cached: int = 400_000):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if (
            proto.trainer_spec.model_type != 2
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not (norm.add_dummy_prefix and norm.escape_whitespaces and proto.trainer_spec.byte_fallback)
            or any(p.type not in (NORMAL, BYTE, 2, 3) for p in proto.pieces)
        ):
            raise ValueError("a merge-type model with identity normalisation and byte fallback is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids, self.cost, bytes_ = {}, {}, {}
        alone, crossing = set(), False
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                # Here a blank stands for the vocabulary's mark, so that ASCII texts stay ASCII.
                piece = p.piece.replace(SPACE, " ")
                self.ids[piece], self.cost[piece] = i, -p.score
                if len(piece) > 1:
                    alone.update(piece)
                    crossing |= bool(re.search("[^ ] ", piece))
            elif p.type == BYTE:
                bytes_[int(p.piece[1:-1], 16)] = i
        self.bytes = [bytes_[b] for b in range(256)]
        self.parts = re.compile("(?s).+" if crossing else _breaks(self.ids, "\n" not in alone)).findall
        self.digits = [str(i) for i in range(len(proto.pieces))]
        self.cache = _Parts(self.merged, cached)

    def merged(self, part: str) -> tuple[int, ...]:
        """Ids of a part by the agenda: a plain list for short parts, a heap for longer ones."""
        symbols = self.short_agenda(part) if len(part) <= SHORT else self.heap_agenda(part)
        out: list[int] = []
        for s in symbols:
            piece = self.ids.get(s)
            if piece is None:
                out.extend(self.bytes[b] for b in s.replace(" ", SPACE).encode())
            else:
                out.append(piece)
        return tuple(out)

    def short_agenda(self, part: str) -> list[str]:
        """The symbols left. Agenda: the cost of each adjacent pair, in order; the first least merges."""
        symbols, cost = list(part), self.cost.get
        agenda = [cost(a + b, NEVER) for a, b in zip(part, part[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            symbols[i] = grown = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + grown, NEVER)
            if i < len(agenda):
                agenda[i] = cost(grown + symbols[i + 1], NEVER)
        return symbols

    def heap_agenda(self, part: str) -> list[str]:
        """The symbols left. Agenda's entries: (cost, start, the pair as one string)."""
        symbols, n, cost = list(part), len(part), self.cost.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if (c := cost(pair)) is not None:
                agenda.append((c, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left, j = symbols[i], after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != len(pair):
                continue  # a merge has changed one of the two since
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                grown = pair + symbols[k]
                if (c := cost(grown)) is not None:
                    heapq.heappush(agenda, (c, i, grown))
            if (h := before[i]) >= 0:
                grown = symbols[h] + pair
                if (c := cost(grown)) is not None:
                    heapq.heappush(agenda, (c, h, grown))
        return [s for s in symbols if s]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        parts = self.parts(" " + (text.replace(SPACE, " ") if SPACE in text else text))
        return list(chain.from_iterable(map(self.cache.__getitem__, parts)))

    def digest(self, ids: list[int]) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        return hashlib.sha256(",".join(map(self.digits.__getitem__, ids)).encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


_codecs: dict[bytes, Codec] = worker_cache({})


def codec_of(model: bytes) -> Codec:
    """The codec of a model, kept for the next tasks of this worker; one model at a time."""
    alone(_codecs)
    if model not in _codecs:
        _codecs.clear()
        _codecs[model] = Codec(model)
    return _codecs[model]


SCHEMA = "{id} long, ids array<int>, decoded string, n_tokens long, ids_sha256 string, decoded_sha256 string, checked boolean"


def encoded(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of docs: its id, ids, decoded text, n_tokens, digests and checked.

    ids_sha256: of the decimal ids joined by commas. decoded_sha256: of the decoded text in UTF-8.
    Null texts count as empty: no ids, empty decoded text. checked: whether the library's ids are
    the same; all else comes from the agenda's. With texts=False ids and decoded are left
    out. Repeated rows and an empty table need no rule; other columns are not read. The model goes
    to the executors as bytes (its size: the vocabulary file's, about half a MB).
    """
    schema = SCHEMA.format(id=id_col) if texts else SCHEMA.format(id=id_col).replace("ids array<int>, decoded string, ", "")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        gc.disable()  # no cycles are made here, and looking for them walks through the cache
        try:
            for whole in batches:
                for batch in slices(whole, 256):
                    yield one(codec, batch)
        finally:
            gc.enable()

    def one(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [t or "" for t in batch.column("text").to_pylist()]
        truth = codec.library.encode(rows, num_threads=1)
        own = [codec.encode(t) for t in rows]
        checked = [a == b for a, b in zip(own, truth)]
        decoded = codec.library.decode(own, num_threads=1)
        arrays = [batch.column("id")]
        if texts:
            arrays += [pa.array(own, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
        arrays += [
            pa.array([len(ids) for ids in own], pa.int64()),
            pa.array([codec.digest(ids) for ids in own], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
            pa.array(checked, pa.bool_()),
        ]
        names = [id_col, *(["ids", "decoded"] if texts else []), "n_tokens", "ids_sha256", "decoded_sha256", "checked"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, schema)
