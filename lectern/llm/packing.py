"""Bounded-space online packing of tokenized documents into fixed windows.

Each partition keeps a fixed number of open windows. A document's ids, with the end id, are cut into
whole windows and a rest; the rest goes to the open window that it fits best. Where it fits none and
all windows are in use, the fullest is topped up by a cut of the rest and emitted. At the end the
leftovers are merged: their pieces are laid end to end into whole windows, and what remains becomes
sequences at powers of two, which need no padding. So no token of padding is written, only rests
that meet a full window are cut, and memory is the open windows' piece lists, whatever the input.

Executors may be lost: the input of a partition is a file split, read in file order, so a repeated
task gives the same pieces and the same sequence ids (partition number, counter).

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty
table gives no pieces; only the id and text columns are read. Rows of one document in the result
tile it: each id lies in exactly one piece.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import read

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Characters that Python's split takes as white space and the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4



def _byte_letters() -> list[str]:
    """The characters that byte-level vocabularies write bytes as: printable ones stand for
    themselves, the others are numbered from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


BYTES = _byte_letters()


@dataclass(frozen=True)
class Packing:
    tokenizer: str  # path of the vocabulary file
    window: int = 2048
    open_windows: int = 64
    end_id: int = 1
    cached_words: int = 250_000


class WordIds(dict):
    """word -> ids as little-endian unsigned 32-bit bytes. The vocabulary drops white space and no
    token spans it, so a text's ids are those of its words, one after the other; likewise a run of
    letters and the marks after it are tokens apart, and case is folded. Both kinds of entry are kept
    up to a bounded number, the words that came first: the frequent ones are among them."""

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.runs = Tokenizer.from_file(path), limit, {}

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if LITTLE else b"".join(i.to_bytes(4, "little") for i in ids)

    def letters(self, run: str) -> bytes:
        """Of letters below U+0250, whose normal form is themselves and whose case folds one by one:
        the merges alone, without the steps before them."""
        text = run if run.isascii() else "".join(BYTES[b] for b in run.encode())
        return array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def run(self, run: str, plain: bool) -> bytes:
        if (ids := self.runs.get(run)) is None:
            ids = self.letters(run) if plain and LITTLE else self.encode(run)
            if len(self.runs) < 2 * self.limit and len(run) <= 64:
                self.runs[run] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(".,;:!?")
        if letters.isalpha():
            plain = max(letters) < "\u0250" and "\u0130" not in letters
            ids = self.run(letters.lower() if plain else letters, plain)
        else:
            letters, ids = "", b""
        if rest := word[len(letters) :]:
            ids += self.run(rest, False)
        if len(self) < self.limit and len(word) <= 64:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(path: str, limit: int) -> WordIds:
    """One for all tasks of a worker process."""
    held = sys.modules.setdefault("_lectern_word_ids", types.ModuleType("_lectern_word_ids"))
    if getattr(held, "key", None) != (path, limit):
        held.key, held.words = (path, limit), WordIds(path, limit)
    return held.words


class Packer:
    """Windows of one partition. A piece is (doc, start, length, crc, doc_tokens)."""

    def __init__(self, base: int, window: int, open_windows: int):
        self.next, self.window, self.most = base, window, open_windows
        self.open: list[list] = []  # [used, pieces]
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.emit([(doc, start, ids[4 * start : 4 * (start + self.window)], total)])
            start += self.window
        if start < total:
            self.place(doc, start, ids[4 * start :], total)

    def place(self, doc, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        best = None
        for w in self.open:
            if w[0] + n <= self.window and (best is None or w[0] > best[0]):
                best = w
        if best is None and len(self.open) < self.most:
            self.open.append(best := [0, []])
        if best is None:
            best = max(self.open, key=lambda w: w[0])
            room = self.window - best[0]
            best[1].append((doc, start, ids[: 4 * room], total))
            self.emit(best[1])
            self.open.remove(best)
            start, ids, n = start + room, ids[4 * room :], n - room
            self.open.append(best := [0, []])
        best[1].append((doc, start, ids, total))
        best[0] += n
        if best[0] == self.window:
            self.emit(best[1])
            self.open.remove(best)

    def finish(self) -> None:
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        left = sum(len(p[2]) // 4 for p in pieces)
        self.open = []
        at = 0
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= size
            taken = []
            while size:
                doc, start, ids, total = pieces[at]
                n = min(size, len(ids) // 4)
                taken.append((doc, start, ids[: 4 * n], total))
                size -= n
                if 4 * n == len(ids):
                    at += 1
                else:
                    pieces[at] = (doc, start + n, ids[4 * n :], total)
            self.emit(taken)


def pack(df: DataFrame, how: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece, see SCHEMA. sequence_id: partition * 2^40 + number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(how.tokenizer, how.cached_words)
        packer = Packer(TaskContext.get().partitionId() << 40, how.window, how.open_windows)
        end = how.end_id.to_bytes(4, "little")

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True)) or [()] * 7
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, words.text(text.as_py() or "") + end)
                if len(packer.out) >= 20_000:
                    yield flush()
        packer.finish()
        yield flush()

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def padding(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Tokens, sequences and padded tokens: a sequence at a power of two is not padded."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = (F.col("n") == window) | (F.col("n").bitwiseAND(F.col("n") - 1) == 0)
    return per.agg(
        F.sum("n").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum(F.when(whole, F.lit(0)).otherwise(window - F.col("n"))).alias("n_padding"),
    )


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), Packing(public_tokenizers.path("word_bpe_49k.json")))
