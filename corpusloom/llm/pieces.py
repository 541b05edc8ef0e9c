"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiling a model file gives three transducers, composed with each input string:

* the normaliser (``Normaliser``): a dummy prefix, spaces to the meta symbol, and a state for runs of
  spaces where the model drops extra ones.  It is deterministic, so composing it is applying its table of
  arcs.  Models with a character map are refused;
* the pieces: a trie whose paths from the root to a piece are the arcs that a string allows; and
* byte fallback: a character that is no piece is a run of byte pieces (or the unknown piece).

The path of least weight in the tropical semiring (min, +) is the encoding; one search over positions
serves both kinds of models and only their weights differ.  In a unigram model an arc weighs minus the
piece's score.  In a BPE model the merge order decides, which sums of scores do not express; there the
lattice is composed with the acceptor of neighbouring pieces: an arc weighs nothing if merging the
characters of the last piece and its own by score, leftmost first, gives the two back, and infinity
otherwise.  Merges never cross the bounds of final pieces and follow one order of scores and places, so
the merges inside two neighbours are the same alone as in the whole string: a sequence of pieces is the
encoding exactly if each neighbouring pair passes, scores equal or not.  A prefix has one encoding, so a
position has one state of finite weight, and the search needs no other.

Where no piece of the model can span (as a rule before the meta symbol, around line feeds and between
letters and other characters) the input is cut, and each cut is composed alone, with results kept per
process in a table of bounded size.

Defined results: null and empty text have no ids; text longer than a batch is one row like any other;
equal scores merge leftmost first (BPE) and prefer the shorter last piece (unigram); models with pieces
that are user defined or unused are refused; no rows give no rows; repeated rows stay; extra columns are
ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

META = "▁"
#: Segments whose result is kept by a process, in each of two generations.
KEPT = 250_000
INF = float("inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Normaliser:
    """From text to the characters pieces are made of: arcs, and a state after a space."""

    def __init__(self, spec):
        if spec.precompiled_charsmap:
            raise ValueError("models with a character map are not supported")
        space = META if spec.escape_whitespaces else " "
        self.arcs = {" ": space}  # any other character gives itself
        self.start = space if spec.add_dummy_prefix else ""
        #: In the state after a space (and at the start), another space has no output.
        self.runs = re.compile("^ +| +$|(?<= ) +") if spec.remove_extra_whitespaces else None

    def __call__(self, text: str) -> str:
        if self.runs is not None:
            text = self.runs.sub("", text)
        for read, written in self.arcs.items():
            text = text.replace(read, written)
        return self.start + text if text else ""


class Transducer:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        kind = pb.ModelProto.SentencePiece
        if m.trainer_spec.model_type not in (pb.TrainerSpec.BPE, pb.TrainerSpec.UNIGRAM):
            raise ValueError("the model is neither BPE nor unigram")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in m.pieces):
            raise ValueError("models with user defined or unused pieces are not supported")
        self.bpe = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.normalised = Normaliser(m.normalizer_spec)
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.surface = [p.piece for p in m.pieces]
        self.score = [p.score for p in m.pieces]
        self.ids: dict[str, int] = {}
        self.bytes = [-1] * 256
        self.unknown = 0
        self.out = []
        for i, p in enumerate(m.pieces):
            raw = p.piece.replace(META, " ").encode()
            if p.type == kind.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                raw = bytes([int(p.piece[1:-1], 16)])
            elif p.type == kind.NORMAL:
                self.ids[p.piece] = i
            elif p.type == kind.UNKNOWN:
                self.unknown, raw = i, m.trainer_spec.unk_surface.encode()
            elif p.type == kind.CONTROL:
                raw = b""
            self.out.append(raw)
        self.fallback = all(b >= 0 for b in self.bytes)
        self.chars = {c for s in self.ids for c in s}
        #: Arcs: a node maps the next character to a node, and "" to the piece that ends there.
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        #: A character that is no piece has a number behind all pieces.
        self.n = len(self.surface)
        self.span = self.n + 0x110000
        self.missing = 0.0 if self.bpe else 10.0 - min(self.score)
        #: Weight of an arc after a last piece (BPE), or of the arc alone.
        self.weights: dict[int, float] = {} if self.bpe else {i: -self.score[i] for i in self.ids.values()}
        self.segments = self._cutter()
        self.kept: dict[str, bytes] = _Kept(self)

    def _cutter(self):
        """Cuts a string where no piece can span: before the meta symbol, around line feeds, tabs and
        carriage returns, and between letters and other characters, as far as the pieces allow each."""
        pairs = {s[k : k + 2] for s in self.ids for k in range(len(s) - 1)}
        if any(p[1] == META and p[0] != META for p in pairs):
            return lambda s: [s] if s else []
        alone = "".join(c for c in "\n\t\r" if c not in self.chars)
        odd = "".join(sorted(c for c in self.chars if not c.isalpha() and re.fullmatch(r"[^\W\d_]", c)))
        letter = re.compile(rf"[^\W\d_{odd}]").fullmatch
        if any(META not in p and bool(letter(p[0])) != bool(letter(p[1])) for p in pairs):
            parts = [f"{META}+[^{META}{alone}]*", f"[^{META}{alone}]+"]
        else:
            other = f"(?:[\\d_{odd}]|[^\\w{META}{alone}])+"
            parts = [f"{META}*[^\\W\\d_{odd}]+", f"{META}*{other}", f"{META}+"]
        return re.compile("|".join(parts + ([f"[{alone}]"] if alone else []))).findall

    # -- the acceptor of neighbouring pieces -------------------------------------------------------
    def merged(self, s: str) -> list[str]:
        """Characters of one or two pieces merged by score, highest and leftmost first."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, i: int) -> str:
        return self.surface[i] if i < self.n else chr(i - self.n)

    def _weigh(self, last: int, i: int) -> float:
        """0 if the pair stays as it is; a piece after no piece must be what its characters give."""
        pair = [self._text(last), self._text(i)] if last >= 0 else [self._text(i)]
        w = self.weights[last * self.span + i] = 0.0 if self.merged("".join(pair)) == pair else INF
        return w

    def _missing(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    # -- composition with one segment and its shortest path ----------------------------------------
    def shortest(self, s: str) -> list[int]:
        n, trie, weights, bpe = len(s), self.trie, self.weights, self.bpe
        cost, last, back = [0.0] + [INF] * n, [-1] * (n + 1), [0] * (n + 1)
        base = 0
        for j in range(n):
            here = cost[j]
            if here == INF:
                continue
            if bpe:
                base = last[j] * self.span
            node, k, alone = trie.get(s[j]), j + 1, False
            while node is not None:
                i = node.get("")
                if i is not None:
                    alone = alone or k == j + 1
                    w = weights.get(base + i)
                    if w is None:
                        w = self._weigh(last[j], i)
                    if here + w < cost[k]:
                        cost[k], last[k], back[k] = here + w, i, j
                if k == n:
                    break
                node = node.get(s[k])
                k += 1
            if not alone:
                c = s[j]
                i, w = (self.n + ord(c) if c in self.chars else -1), self.missing
                if bpe and i >= 0:
                    w = weights.get(base + i)
                    if w is None:
                        w = self._weigh(last[j], i)
                if here + w < cost[j + 1]:
                    cost[j + 1], last[j + 1], back[j + 1] = here + w, i, j
        path, j = [], n
        while j:
            i = last[j]
            path.append([i] if 0 <= i < self.n else self._missing(s[back[j]]))
            j = back[j]
        return self._joined([i for part in reversed(path) for i in part])

    def _joined(self, ids: list[int]) -> list[int]:
        """A run of unknown characters is one unknown piece."""
        if self.fallback or self.unknown not in ids:
            return ids
        return [i for k, i in enumerate(ids) if i != self.unknown or not k or ids[k - 1] != self.unknown]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian int32."""
        return b"".join(map(self.kept.__getitem__, self.segments(self.normalised(text)))) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "each_byte")
        return out[1:] if self.prefix and out.startswith(" ") else out


class _Kept(dict):
    """Results of segments in two generations: a full one becomes the old one, and what is used again
    moves to the new one, so frequent segments stay."""

    def __init__(self, of: Transducer):
        self.of, self.old = of, {}

    def __missing__(self, segment: str) -> bytes:
        ids = self.old.get(segment)
        if ids is None:
            ids = np.array(self.of.shortest(segment), dtype="<i4").tobytes()
        if len(segment) <= 64:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[segment] = ids
        return ids


_compiled: dict[str, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer per process and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def encode(documents: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids, round_trip (decoding the ids gives the text back)."""
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                coded = [t.encode(x) for x in texts]
                sizes = np.array([len(c) // 4 for c in coded], dtype=np.int64)
                same = [t.decode(np.frombuffer(c, "<i4")) == (x or "") for c, x in zip(coded, texts, strict=True)]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids, pa.array(same)], schema=_OUT)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    with open(model_path or default_model(), "rb") as f:
        model = f.read()
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(held.value)
        for batch in batches:
            texts = [t.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
