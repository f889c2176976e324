"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into one transducer, a composition of three:

* the normaliser: the model's character map, which reads the longest sequence it knows and writes another
  (compiled from the double-array trie in the model file), the removal of extra white space where the
  model asks for it, and a word mark before the text and for each space;
* the pieces: for each piece a path that reads its characters and writes its id, and for a character
  of no piece a path that writes the ids of its UTF-8 bytes (byte fallback);
* the weights, in the tropical semiring.  For a unigram model a piece weighs minus its score.  For a
  BPE model the state remembers the last piece, and an arc weighs zero if the merges that lead to the
  two pieces leave the border between them alone, else infinity.  A sequence of pieces is the BPE
  result exactly if no border in it would be merged away, so one path of finite weight is left.

Encoding composes the transducer with the input lazily and takes the shortest path.  No piece goes on
past a character into a word mark (checked when compiling), so a text's shortest path is the
concatenation of those of its words, which are remembered in a bounded table.  Decoding is the inverse,
up to what the normaliser changed: ``round_trip`` is false for texts that it alters.

Defined cases: a null text gives null ids; an empty text gives no ids; a text with the word mark itself
is encoded as the model does and decodes to a space, so ``round_trip`` is false for it; other columns
pass through ``encode`` untouched.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from rowloom.llm.common import keep_between_tasks, table, tidy

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows that are encoded at once.
_ROWS = 256
#: Words whose paths a worker remembers, twice: the older half goes when the newer is full.
REMEMBERED = 250_000
_NORMAL, _USER, _UNUSED, _BYTE, _UNKNOWN = 1, 4, 5, 6, 2
_UNIGRAM, _BPE = 1, 2
INFINITY = float("inf")


def read_model(path: str) -> dict:
    """What the transducer is made of, as plain values."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if model.trainer_spec.treat_whitespace_as_suffix or not norm.escape_whitespaces:
        raise ValueError("only models that write white space as a mark before the word are supported")
    if model.trainer_spec.model_type not in (_UNIGRAM, _BPE):
        raise ValueError("only unigram and BPE models are supported")
    return {
        "bpe": model.trainer_spec.model_type == _BPE,
        "prefix": norm.add_dummy_prefix,
        "squeeze": norm.remove_extra_whitespaces,
        "map": character_map(norm.precompiled_charsmap),
        "fallback": model.trainer_spec.byte_fallback,
        "pieces": [(p.piece, p.score, p.type) for p in model.pieces],
    }


def character_map(blob: bytes) -> dict[str, str]:
    """Sequences and what the normaliser writes for them, read out of a model's compiled map.

    The map is a double-array trie behind its size in bytes, then the written texts, each ended by a zero byte.
    A unit holds the label that leads to it, a leaf mark and the offset of its children; a leaf holds
    where the written text begins.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    labels = np.arange(1, 256)
    made, open_ = {}, [(0, b"")]
    while open_:
        at, read = open_.pop()
        unit = int(units[at])
        base = at ^ ((unit >> 10) << ((unit & 512) >> 6))
        if unit & 256:
            start = int(units[base]) & 0x7FFFFFFF
            made[read.decode()] = texts[start : texts.index(b"\0", start)].decode()
        below = base ^ labels
        below = below[below < len(units)]
        met = below[(units[below] & 0x800000FF) == (base ^ below)]
        open_ += [(int(q), read + bytes([base ^ int(q)])) for q in met]
    return made


class Normaliser:
    """Reads the longest known sequence at each place and writes what the model's map has for it."""

    def __init__(self, model: dict):
        self.map, self.squeeze = dict(model.get("map") or {}), model.get("squeeze", False)
        self.mark = MARK if model["prefix"] else ""
        for piece, _, kind in model["pieces"] if self.map else ():
            if kind == _USER:  # pieces that the model's maker named stay as they are
                self.map[piece] = piece
        self.longest: dict[str, int] = {}
        for read in self.map:
            self.longest[read[0]] = max(len(read), self.longest.get(read[0], 0))
        self.starts = re.compile("[" + "".join(map(re.escape, sorted(self.longest))) + "]") if self.map else None

    def written(self, text: str) -> str:
        """``text`` with its known sequences replaced, from left to right."""
        if not self.starts or not (met := self.starts.search(text)):
            return text
        out, done, known = [], 0, self.map
        while met:
            k = met.start()
            for n in range(self.longest[text[k]], 0, -1):
                if (got := known.get(text[k : k + n])) is not None:
                    out += text[done:k], got
                    done = k + n
                    break
            else:
                n = 1
            met = self.starts.search(text, k + n)
        return "".join(out) + text[done:]

    def __call__(self, text: str) -> str:
        made = self.written(text)
        if self.squeeze:
            made = re.sub(" {2,}", " ", made).strip(" ")
            if not made:
                return ""
        made = self.mark + made.replace(" ", MARK)
        return made.rstrip(MARK) if self.squeeze else made


class _Remembered(dict):
    """Words and the ids of their paths; finds the path of a word when it is first asked for."""

    def __init__(self, find):
        self.find, self.older = find, {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.find(word)
        if len(self) >= REMEMBERED:  # words that nobody asks for until the next time go
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got


class Transducer:
    def __init__(self, model: dict):
        self.model, self.pieces, self.normal = model, model["pieces"], Normaliser(model)
        written = [i for i, p in enumerate(self.pieces) if p[2] in (_NORMAL, _USER)]
        self.id_of = {self.pieces[i][0]: i for i in written}
        self.score = {self.pieces[i][0]: self.pieces[i][1] for i in written}
        self.byte_id = {int(p[0][1:-1], 16): i for i, p in enumerate(self.pieces) if p[2] == _BYTE}
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == _UNKNOWN)
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.id_of)
        self.text_of = [self._bytes_of(*p) for p in self.pieces]
        #: Pairs of neighbouring characters in pieces: between any others no path has to be carried on.
        self.joined = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.remembered = _Remembered(self._word)
        if model["bpe"]:
            ranked = sorted({s for s in self.score.values()}, reverse=True)
            level = {s: r + 1 for r, s in enumerate(ranked)}
            self.rank = {p: level[s] for p, s in self.score.items()}
            self.order = {p: 0 if len(p) == 1 else r for p, r in self.rank.items()}
            self.left, self.right = {}, {}
            for p in list(self.id_of):
                if len(p) > 1:
                    self._derive(p)
            usable = {p for p in self.id_of if len(p) == 1 or p in self.left}
        else:
            usable = set(self.id_of)
            #: Weight of a character that is no piece by itself: 10 more than the heaviest piece, as in the library.
            self.strange = 10 - min(self.score.values(), default=0.0)
        #: States of the piece transducer by the characters read, with the id that may be written there, or -1.
        self.states = {p[:i]: -1 for p in usable for i in range(1, len(p))} | {p: self.id_of[p] for p in usable}
        self.borders: dict[int, bool] = {}

    @staticmethod
    def _bytes_of(piece: str, score: float, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[1:-1], 16)])
        return piece.replace(MARK, " ").encode() if kind in (_NORMAL, _USER, _UNUSED) else b" \xe2\x81\x87 " if kind == _UNKNOWN else b""

    def _derive(self, piece: str) -> None:
        """The last merge that makes the piece; a piece that merging never reaches gets none."""
        parts = list(piece)
        ends = (parts[0], "")
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, INFINITY), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == INFINITY:
                return
            i = best[1]
            ends = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.left[piece], self.right[piece] = ends

    def _border(self, a: str, b: str) -> float:
        """Weight of piece b after piece a: infinity if merging would join parts across the border."""
        rank, order, limit = self.rank, self.order, INFINITY
        while True:
            if rank.get(a + b, INFINITY) < limit:
                return INFINITY
            x, y = order[a], order[b]
            if x == 0 and y == 0:
                return 0.0
            # The part made last is taken apart: before that merge its inner half stood at the border.
            if x > y:
                limit, a = x, self.right[a]
            else:
                limit, b = y + 1, self.left[b]

    def path(self, word: str) -> list[int]:
        """Ids along the shortest path of the transducer composed with ``word`` (normalised)."""
        arcs = self._allowed_path(word) if self.model["bpe"] else self._lightest_path(word)
        if min(arcs, default=0) >= 0:
            return arcs
        out, i = [], 0
        for t in arcs:
            out += [t] if t >= 0 else self._spelled(word[i])
            i += len(self.pieces[t][0]) if t >= 0 else 1
        return out

    def _arcs(self, word: str, k: int) -> list[int]:
        """Ids of the pieces that can be read from position k, shortest first; else -1, which spells the character."""
        found, get = [], self.states.get
        for i in range(k + 1, len(word) + 1):
            t = get(word[k:i])
            if t is None:
                break
            if t >= 0:
                found.append(t)
        return found or [-1]

    def _allowed(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a, remembered; spelled characters may stand anywhere."""
        if a < 0 or b < 0:
            return True
        if len(self.borders) >= REMEMBERED:
            self.borders.clear()
        self.borders[a << 32 | b] = got = self._border(self.pieces[a][0], self.pieces[b][0]) == 0
        return got

    def _allowed_path(self, word: str) -> list[int]:
        """The path of weight zero, depth first, longer pieces first.

        A prefix has one allowed path only, so a position that leads nowhere is never met again.
        """
        whole = self.states.get(word, -1)
        if whole >= 0:
            return [whole]
        n, known, allowed, pieces, trail, k = len(word), self.borders.get, self._allowed, self.pieces, [], 0
        arcs, before = self._arcs(word, 0) if n else [], -1
        while k < n:
            while arcs:
                t = arcs.pop()
                ok = known(before << 32 | t)
                if ok or ok is None and allowed(before, t):
                    break
            else:
                k, arcs, before = trail.pop()[1:]
                continue
            trail.append((t, k, arcs, before))
            k, before = k + (len(pieces[t][0]) if t >= 0 else 1), t
            if k < n:
                arcs = self._arcs(word, k)
        return [t[0] for t in trail]

    def _lightest_path(self, word: str) -> list[int]:
        n, of = len(word), self.id_of
        cost, came = [0.0] + [INFINITY] * n, [(0, -1)] * (n + 1)
        for k in range(n):
            arcs = self._arcs(word, k)
            for t in arcs if arcs[0] < 0 or word[k] in of else [*arcs, -1]:
                i = k + (len(self.pieces[t][0]) if t >= 0 else 1)
                total = cost[k] - self.pieces[t][1] if t >= 0 else cost[k] + self.strange
                if total < cost[i]:
                    cost[i], came[i] = total, (k, t)
        out = []
        while n:
            n, t = came[n]
            out.append(t)
        return out[::-1]

    def _spelled(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode()] if self.model["fallback"] else [self.unknown]

    def _word(self, word: str) -> bytes:
        joined = self.joined
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joined]
        if cuts:
            return b"".join([self.remembered[word[i:j]] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)])
        return array("i", self.path(word)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        whole = self.normal(text)
        words = self.words.findall(whole) if self.by_word else [whole]
        known = self.remembered
        ids = np.frombuffer(b"".join([known[w] for w in words]), np.int32)
        if not self.model["fallback"] and len(ids):  # a run of unknown characters is one id
            strange = ids == self.unknown
            ids = ids[~(strange & np.r_[False, strange[:-1]])]
        return ids

    def decode(self, ids) -> str:
        of = self.text_of
        if self.model.get("squeeze"):  # each piece before the first text loses a mark
            k, first = 0, b""
            while k < len(ids) and not first:
                first = of[ids[k]]
                first = first[1:] if first[:1] == b" " and self.pieces[ids[k]][2] != _BYTE else first
                k += 1
            raw = first + b"".join([of[i] for i in ids[k:]])
        else:
            raw = b"".join([of[i] for i in ids])
            raw = raw[1:] if self.model["prefix"] and raw[:1] == b" " else raw
        return raw.decode("utf-8", "replace")


_COMPILED: dict[str, Transducer] = {}


def _transducer(model: dict) -> Transducer:
    """One transducer, with its remembered words, for all tasks of a worker."""
    key = str(hash((model["bpe"], model["prefix"], model["squeeze"], tuple(model["map"].items()), tuple(model["pieces"]))))
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(model)
        keep_between_tasks("sentencepiece", _COMPILED.clear)
    return _COMPILED[key]


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL, check: str | None = None) -> DataFrame:
    """``df`` with the piece ids of the text; ``check`` names a column that tells whether decoding gives it back.

    Columns of ``df`` that have these names are replaced.  The driver reads the model file and sends its values along (under 1 MB for 32,000 pieces).
    """
    shared = df.sparkSession.sparkContext.broadcast(read_model(model))
    df = df.drop(ids_col, *([check] if check else []))
    names, at = [*df.columns, ids_col, *([check] if check else [])], df.columns.index(text_col)

    def run(batches):
        fst = _transducer(shared.value)
        for b in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            texts = b.column(at).to_pylist()
            made = [None if t is None else fst.encode(t) for t in texts]
            ends = np.cumsum([0] + [0 if x is None else len(x) for x in made]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *(x for x in made if x is not None)])
            missing = pa.array([x is None for x in made], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=missing)
            extra = [pa.array([None if t is None else fst.decode(x.tolist()) == t for t, x in zip(texts, made, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, ids, *(extra if check else [])], names=names)
        fst.remembered.older = {}  # the worker lives on, beside those of later stages

    fields = [*df.schema.fields, StructField(ids_col, ArrayType(IntegerType(), False))]
    if check:
        fields.append(StructField(check, BooleanType()))
    return df.mapInArrow(tidy(run, "sentencepiece"), StructType(fields))


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the text that the ids spell; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(read_model(model))
    df = df.drop(text_col)
    names, at = [*df.columns, text_col], df.columns.index(ids_col)

    def run(batches):
        fst = _transducer(shared.value)
        for b in batches:
            ids = b.column(at).to_pylist()
            texts = pa.array([None if x is None else fst.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=names)

    return df.mapInArrow(tidy(run, "sentencepiece"), StructType([*df.schema.fields, StructField(text_col, StringType())]))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, check="round_trip")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")
