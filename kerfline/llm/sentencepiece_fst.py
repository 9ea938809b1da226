"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser (white-space escape and dummy prefix), the piece
acceptor, and the byte fallback, which spells a character outside the pieces as its UTF-8 bytes. Composed with an
input they give a lattice over its characters, and the shortest path in the tropical semiring is the result.

Weights: for a unigram model, a piece's arc weighs minus its score. For a BPE model the acceptor is one of piece
pairs: the state is the piece just read, and an arc weighs 0 if merging the two neighbouring pieces' characters
gives back these two pieces, else infinity. A sequence is the result of BPE if and only if all its neighbours are
so, and every prefix has one such sequence; so one arc of finite weight ends at each position. (Sums of BPE
scores, which are only ranks, would give other pieces than the model's own encoder.)

No piece holds a word start after another character, so composition runs word by word, and words that come again
are looked up. The table of words is bounded, and emptied when full.

Defined results: null and empty texts have no ids and decode to the empty text; U+2581 in a text is read as a
space, as the model itself does; control pieces written out in a text are ordinary text; models with a
character map or another white-space rule are refused; repeated rows, and rows without an id, are encoded each for itself; texts may be of any length; an empty table
gives an empty result; other columns pass through if asked for in ``keep``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"

# Fixed values of the public model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

INF = float("inf")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = struct.unpack("<f" if n == 4 else "<d", b[i : i + n])[0], i + n
        yield key >> 3, value


class Transducer:
    """Normaliser, pieces and byte fallback of one model."""

    def __init__(self, model: bytes, words: int = 400_000, pairs: int = 1_000_000):
        self.pieces: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        settings = {2: {}, 3: {}}
        for n, v in _fields(model):
            if n == 1:
                x = dict(_fields(v))
                self.pieces.append(x.get(1, b"").decode())
                self.score.append(x.get(2, 0.0))
                self.kind.append(x.get(3, NORMAL))
            elif n in settings:
                settings[n] = dict(_fields(v))
        self.model_type = settings[2].get(3, UNIGRAM)
        norm = settings[3]
        if norm.get(2) or settings[2].get(24) or norm.get(5, 1) == 0 or norm.get(4, 1) or self.model_type not in (UNIGRAM, BPE):
            raise ValueError("only models with an identity normaliser, escaped and kept white space are supported")
        self.prefix = " " if norm.get(3, 1) else ""
        self.byte_fallback = bool(settings[2].get(35))
        of = lambda *kinds: [i for i, k in enumerate(self.kind) if k in kinds]
        self.unk = of(UNKNOWN)[0]
        # In all machines a space stands for the word mark.
        self.ids = {self.pieces[i].replace(MARK, " "): i for i in of(NORMAL, USER)}
        if any(re.search("[^ ] ", p) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in of(BYTE)}
        self.longest = max(map(len, self.ids), default=1)
        together = set("".join(p for p in self.ids if len(p) > 1))
        # Without byte fallback a run of unknown characters is one piece, so these are not cut apart.
        alone = "".join(c for c in map(chr, range(128)) if c not in together and c != " " and (self.byte_fallback or c in self.ids))
        one = re.escape(alone)
        # What no piece holds together is read apart: words, runs of spaces, and characters of their own.
        self.cut = re.compile(f" *[^ {one}]+| +|[{one}]" if alone else " *[^ ]+| +").findall
        self.bad = min(self.score, default=0.0) - 10.0
        self.spelled = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.byte_id.items():
            self.spelled[i] = bytes([b])
        for i in of(CONTROL):
            self.spelled[i] = b""
        self.spelled[self.unk] = " ⁇ ".encode()
        self._pair: dict[int, bool] = {}
        self._pairs = pairs
        if self.model_type == BPE:
            self._compile_pairs()
        self._words = _Words(self, words)

    # Weights.

    def _merged(self, chars: str) -> tuple[list[str], tuple[str, str]]:
        """What BPE merging makes of a short string, best score first and leftmost of equals; and what it merged last."""
        parts, last = list(chars), ("", "")
        while len(parts) > 1:
            best, at = -INF, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.score[k] > best:
                    best, at = self.score[k], i
            if at < 0:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _compile_pairs(self) -> None:
        """The acceptor of pieces that merging can make, and each one's last merge."""
        self.halves: dict[str, tuple[str, str]] = {}
        self.accept = ahocorasick.Automaton()
        for text, i in self.ids.items():
            parts, self.halves[text] = self._merged(text)
            if len(parts) == 1:
                self.accept.add_word(text, (i, len(text)))
        self.accept.make_automaton()

    def _apart(self, u: str, v: str) -> bool:
        """Whether merging leaves two neighbouring pieces apart.

        The characters next to the border are looked at back in time, undoing the later of their two merges: a merge
        across the border must never have been the better one while they stood beside each other."""
        if "  " in u or "  " in v:  # runs of spaces have equal scores
            return self._merged(u + v)[0] == [u, v]
        score = lambda x: self.score[self.ids[x]]
        until, left_first = -INF, True
        while True:
            across = self.ids.get(u + v)
            if across is not None and (self.score[across] > until or self.score[across] == until and not left_first):
                return False
            if len(u) == 1 and len(v) == 1:
                return True
            if len(v) == 1 or len(u) > 1 and score(u) < score(v):
                until, left_first, u = score(u), True, self.halves[u][1]
            else:
                until, left_first, v = score(v), False, self.halves[v][0]

    def _joins(self, before: int, piece: int) -> bool:
        """Whether BPE leaves ``piece`` whole after ``before``; -1: at the start, -2: after a character that no piece has."""
        if before < 0:
            return True
        key = before * 1_000_000 + piece
        known = self._pair.get(key)
        if known is None:
            if len(self._pair) >= self._pairs:
                self._pair.clear()
            known = self._pair[key] = self._apart(self.spelled[before].decode(), self.spelled[piece].decode())
        return known

    # Composition and shortest path.

    def path(self, chunk: str) -> list[int]:
        """Ids along the shortest path through the lattice of a piece of normalised text."""
        last, back = (self._one_path if self.model_type == BPE else self._least_path)(chunk)
        out: list[int] = []
        end = len(chunk)
        while end:
            start = back[end]
            if last[end] >= 0:
                out.append(last[end])
            elif self.byte_fallback:
                out.extend(self.byte_id[b] for b in reversed(chunk[start:end].encode()))
            else:
                out.append(self.unk)
                while start and last[start] == -2:  # one unknown piece for a run
                    start = back[start]
            end = start
        return out[::-1]

    def _one_path(self, chunk: str) -> tuple[list[int], list[int]]:
        """Weights are 0 or infinity, and one arc of weight 0 ends at each position."""
        n, pair = len(chunk), self._pair
        last, back = [-1] * (n + 1), [0] * (n + 1)
        done = 0  # positions that have their arc
        for end, (piece, size) in self.accept.iter(chunk):
            if end < done:
                continue
            while done < end:  # no piece reads these characters
                done += 1
                last[done], back[done] = -2, done - 1
            start = end + 1 - size
            before = last[start]
            fits = before < 0 or pair.get(before * 1_000_000 + piece)
            if fits or fits is None and self._joins(before, piece):
                done = end + 1
                last[done], back[done] = piece, start
        while done < n:
            done += 1
            last[done], back[done] = -2, done - 1
        return last, back

    def _least_path(self, chunk: str) -> tuple[list[int], list[int]]:
        """Weights are the pieces' negated scores."""
        n, get, longest = len(chunk), self.ids.get, self.longest
        cost, last, back = [0.0] + [INF] * n, [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                piece = get(chunk[start:end])
                if piece is not None and cost[start] - self.score[piece] < cost[end]:
                    cost[end], last[end], back[end] = cost[start] - self.score[piece], piece, start
            if end - 1 >= 0 and get(chunk[end - 1 : end]) is None and cost[end - 1] - self.bad < cost[end]:
                cost[end], last[end], back[end] = cost[end - 1] - self.bad, -2, end - 1
        return last, back

    def encode_raw(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self._words.__getitem__, self.cut(self.prefix + text.replace(MARK, " "))))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_raw(text), "<i4").tolist()

    def decode(self, ids) -> str:
        if len(ids) == 0:
            return ""
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Words(dict):
    """Encoded words seen; emptied when full. Long ones are not kept."""

    def __init__(self, machine: Transducer, most: int):
        super().__init__()
        self.machine, self.most = machine, most

    def __missing__(self, word: str) -> bytes:
        out = np.array(self.machine.path(word), "<i4").tobytes()
        if len(word) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out


_LOADED: dict[int, Transducer] = {}


def loaded(model: bytes) -> Transducer:
    """One transducer a worker process and model."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(model)
    return _LOADED[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model_path: str = MODEL, text: str = "text", at_once: int = 4 << 20) -> DataFrame:
    """``keep..., ids, n_tokens, round_trip``: ids of the whole text, and whether decoding them gives the text again."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))  # a file of fixed size
    schema = docs.select(*keep).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = loaded(model.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start, size, raw, same = 0, 0, [], []
            for i in range(batch.num_rows):
                t = texts[i].as_py() or ""
                raw.append(fst.encode_raw(t))
                same.append(fst.decode(np.frombuffer(raw[-1], "<i4").tolist()) == t)
                size += len(raw[-1])
                if size >= at_once or i + 1 == batch.num_rows:
                    ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                    kept = batch.slice(start, len(raw)).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*kept, ids, pa.array(np.diff(ends), pa.int64()), pa.array(same)], names=schema.names)
                    start, size, raw, same = i + 1, 0, [], []

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",), model_path: str = MODEL, ids: str = "ids") -> DataFrame:
    """``keep..., text`` from a column of ids."""
    model = rows.sparkSession.sparkContext.broadcast(read_model(model_path))
    schema = rows.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = loaded(model.value)
        for batch in batches:
            texts = [fst.decode(x.as_py() or ()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return rows.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, schema)
