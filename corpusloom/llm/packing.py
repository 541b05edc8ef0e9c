"""Packing by concatenate and cut: documents end to end, cut in windows of a fixed number of tokens.

1. Tokens.  Each task tokenises its documents in the order it reads them and stores, per document, the ids
   (unsigned 32-bit, little-endian) and the number of tokens before it in the task's own stream.
2. Offsets.  Token totals per task, a row each, are summed up in the order of tasks; the sum before a task
   plus the place inside its stream is the document's global offset.  Neither pass moves tokens to another task
   but for the join with the sums, which Spark broadcasts while it is small (16 bytes a task).
3. Cut.  Window k holds the tokens from ``k * length`` on; a document overlaps a run of windows and gives
   one piece (boundary record) for each.  Pieces are numbers, arithmetic on one row; a document of any length
   never meets another in a task.

The last window is rarely full.  Where ``length`` is a power of two its tokens are cut at falling powers of two (at most
log2 of them), and such sequences need no padding at all; any other last sequence is padded to ``length``.

Defined results: null and empty texts give the end id alone; null and equal doc_ids are documents like any other;
no rows give no rows; texts of any length are one document.  Which documents are neighbours follows the order of the
input's files and splits, so pieces of one text may be cut elsewhere if the input is laid out differently.  Extra
columns are ignored unless named in ``keep``, which come back as kept_*.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import WORD, stored, table

LENGTH = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Characters handled in one call, and entries of a process's tables, which bound its memory.
CALL_CHARS = 1 << 20
KEPT = 1 << 18

#: The vocabulary's own split rule, on lower-case text of ASCII and Latin-1 letters (contractions, runs of
#: letters, single digits, runs of anything else), and the string with which its special tokens begin.
_PLAIN = re.compile(r"[\x09-\x0D\x20-~À-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\x20\x09-\x0D]+")
_SPECIAL = "<|"
_WORDS = re.compile(WORD)


class _Table(dict):
    """A bounded memory of a function's results: two generations, of which the older goes when the younger is full."""

    def __init__(self, f: Callable[[str], bytes], most: int):
        self.f, self.most, self.older = f, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.f(key)
        self[key] = out
        return out


def _packed(ids: Sequence[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies spell each byte: printable Latin-1 itself, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of a whole text by a vocabulary whose words never cross ASCII white space.

    A text of plain letters is split by the vocabulary's rule and its parts are looked up, unseen ones going straight to
    the BPE model; in any other text words are looked up, unseen ones going through the whole tokenizer.  Equal to the tokenizer on
    the whole text.
    """

    def __init__(self, path: str, kept: int = KEPT):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.words = _Table(self._word, kept)
        self.parts = _Table(self._part, kept)

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        return _packed([t.id for t in self.model.tokenize(spelt)])

    def _word(self, word: str) -> bytes:
        return _packed(self.whole.encode(word, add_special_tokens=False).ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _PLAIN.fullmatch(text) and _SPECIAL not in text:
            text, split, known = text.lower(), _PARTS, self.parts
        else:
            split, known = _WORDS, self.words
        if len(text) <= CALL_CHARS:
            return b"".join(map(known.__getitem__, split.findall(text)))
        out = bytearray()
        for m in split.finditer(text):  # no list of all words of a very long text
            out += known[m[0]]
        return bytes(out)


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The process's encoder, which tasks share."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def tokens(docs: DataFrame, vocabulary: str | None = None, *, end_id: int = END_ID, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, kept_*, _part (task), _lo (tokens before it in the task), _n, _ids: stored, in the order of the input.

    vocabulary: a file that every worker can read; None is the public one installed beside Python.
    """
    asked = docs.select("doc_id", *[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep], F.col("text").alias("_text"))
    held = asked.schema.fields[:-1]
    fields = [T.StructField("_part", T.LongType()), T.StructField("_lo", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_ids", T.BinaryType())]
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary or default_vocabulary())
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            made, size, first = [], 0, 0
            column = batch.column("_text")
            for i in range(len(column)):
                made.append(encoder(column[i].as_py()) + end)
                size += len(made[-1])
                if size >= 4 * CALL_CHARS or i + 1 == len(column):
                    lengths = [len(x) // 4 for x in made]
                    starts = [at]
                    for n in lengths:
                        starts.append(starts[-1] + n)
                    at = starts.pop()
                    own = batch.slice(first, len(made)).columns[:-1]
                    new = [pa.array([part] * len(made), pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(made, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*own, *new], [*batch.schema.names[:-1], "_part", "_lo", "_n", "_ids"])
                    made, size, first = [], 0, i + 1

    return stored(asked.mapInArrow(encode, T.StructType([*held, *fields])))


def bases(rows: DataFrame) -> DataFrame:
    """_part, _base: the tokens of all earlier tasks.  One window over a row per task of the first pass."""
    totals = rows.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_base"))


def last_windows(total: int, length: int) -> list[tuple[int, int, int]]:
    """(sequence_id, from, to) of the sequences that hold what full windows leave over."""
    number, at = divmod(total, length)[0], total - total % length
    if length & (length - 1):
        return [(number, at, total)] if at < total else []
    out = []
    for size in (1 << b for b in reversed(range((total - at).bit_length()))):
        if (total - at) & size:
            out.append((number + len(out), at, at + size))
            at += size
    return out


def pack(
    docs: DataFrame, vocabulary: str | None = None, *, length: int = LENGTH, end_id: int = END_ID, keep: Sequence[str] = (), ids: bool = True
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, kept_*, ids (array).

    sequence_length is the length after padding.  ``ids=False`` leaves the ids themselves out.
    """
    rows = tokens(docs, vocabulary, end_id=end_id, keep=keep)
    base = stored(bases(rows))
    total = rows.agg(F.sum("_n")).first()[0] or 0
    full = total // length
    window = "struct(k AS id, k * {n}L AS lo, (k + 1) * {n}L AS hi)".format(n=length)
    whole = F.expr(f"transform(sequence(_at div {length}, least((_at + _n - 1) div {length}, {full - 1}L)), k -> {window})") if full else None
    none = F.expr("cast(array() as array<struct<id:bigint,lo:bigint,hi:bigint>>)")
    runs = none if whole is None else F.when(F.col("_at") < full * length, whole).otherwise(none)
    for i, lo, hi in last_windows(total, length):
        own = F.array(F.struct(F.lit(i).cast("long").alias("id"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")))
        runs = F.concat(runs, F.when((F.col("_at") < hi) & (F.col("_at") + F.col("_n") > lo), own).otherwise(none))
    start, stop = "greatest(w.lo, _at)", "least(w.hi, _at + _n)"
    cut = f"substring(_ids, cast(4 * ({start} - _at) + 1 as int), cast(4 * ({stop} - {start}) as int))"
    size = length if length & (length - 1) else f"if(w.hi - w.lo < {length}, w.hi - w.lo, {length}L)"
    record = (
        f"struct({start} - _at AS start, {stop} - {start} AS length, crc32({cut}) AS ids_crc32, _n AS doc_tokens, w.id AS sequence_id,"
        f" {start} - w.lo AS offset, cast({size} as bigint) AS sequence_length" + (f", {cut} AS _cut)" if ids else ")")
    )
    kept = [f"kept_{c}" for c in keep]
    out = rows.join(base, "_part").withColumn("_at", F.col("_base") + F.col("_lo")).withColumn("_runs", runs)
    out = out.select("doc_id", *kept, F.inline(F.expr(f"transform(_runs, w -> {record})")))
    if not ids:
        return out
    digits = " || ".join(f"substr(_cut, 8 * i + {k}, 2)" for k in (7, 5, 3, 1))  # little-endian
    numbers = f"transform(sequence(0, cast(length as int) - 1), i -> cast(conv({digits}, 16, 10) as int))"
    return out.withColumn("_cut", F.hex("_cut")).withColumn("ids", F.expr(numbers)).drop("_cut")


def sequences(pieces: DataFrame, pad_id: int) -> DataFrame:
    """sequence_id, ids (padded to sequence_length), n_tokens: the training sequences of pack(..., ids=True).

    A group is one sequence, at most ``length`` pieces.
    """
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = pieces.groupBy("sequence_id").agg(held.alias("_p"), F.sum("length").alias("n_tokens"), F.first("sequence_length").alias("_size"))
    flat = F.flatten(F.transform("_p", lambda p: p["ids"]))
    return out.select("sequence_id", F.concat(flat, F.array_repeat(F.lit(pad_id), (F.col("_size") - F.col("n_tokens")).cast("int"))).alias("ids"), "n_tokens")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pack(docs, ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
