"""Packing by concatenate-and-cut.

Pass one tokenizes each whole text once, appends the end id and writes (part,
place in the part, ids) to the shared folder; each part is one partition of
the input. Pass two sums the tokens of each part; prefix sums over these totals
(two numbers for each part are all that the driver holds) give each document
its global offset. The stream of all ids is cut into windows of ``length``;
a document that crosses a border is cut there, so every window but the last is
full. Each piece is a record of its document, its place in it, its window and
its place there, with ``continues`` for pieces that go on in the next window.

Pass two is DataFrame functions only and reads each part once. A lost executor
costs its tasks alone: offsets come from written files, not from a rerun.

Tokenizing: byte-level BPE never merges across the start of a space-led word,
so the ids of a text are those of its space-separated chunks, each with its
leading space. Chunks repeat, so their ids are kept in a bounded table. A text
in which a space touches other white space is tokenized as a whole.

Cases: null text is empty text, which is the end id alone; rows with equal ids
are packed each for itself; an empty table gives no pieces; other columns are
ignored. Windows are padded to ``length``, except where a window's own length
is a power of two (``padded_length``); only the last window can be short.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

LENGTH = 1024
END_ID = 0
#: Chunks whose ids a worker keeps; beyond it the table is emptied.
KEPT_CHUNKS = 600_000
#: Rows tokenized at once, which bounds the ids held in a worker.
ROWS_AT_ONCE = 500

_PIECES = "part int, start_in_part bigint, doc_id bigint, doc_tokens bigint, ids binary"


#: Fixed value: the pattern by which byte-level BPE splits text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ChunkTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes, for a byte-level BPE tokenizer file.

    Chunks are merged by tiktoken from the file's own vocabulary, whose ids are
    merge ranks; texts with white space beside a space or with the strings of
    special tokens go through the tokenizer itself.
    """

    def __init__(self, path: str, kept: int = KEPT_CHUNKS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word not in self.special}
        self.merged = tiktoken.Encoding("chunks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.led: dict[str, bytes | None] = {}  # ids of chunks after a space; None: the text must be taken whole

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, chunk: str, lead: str) -> bytes | None:
        if any(s in chunk for s in self.special):
            return None
        return array("I", self.merged(lead + chunk)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        led = self.led
        if len(led) > self.kept:
            led.clear()
        out, whole = [], []
        for i, text in enumerate(texts):
            head, *chunks = text.split(" ")
            for chunk in {*chunks}.difference(led):
                led[chunk] = None if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self._chunk(chunk, " ")
            first = None if chunks and (not head or head[-1].isspace()) else self._chunk(head, "")
            ids = list(map(led.__getitem__, chunks))
            if first is None or None in ids:
                whole.append(i)
                out.append(b"")
            else:
                out.append(first + b"".join(ids))
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        return out


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """part, start_in_part, doc_id, doc_tokens and ids of each row, the end id included."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        tokenizer, end = ChunkTokenizer(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                ids = [x + end for x in tokenizer.encode([t or "" for t in rows.column(1).to_pylist()])]
                counts = [len(x) // 4 for x in ids]
                starts = []
                for n in counts:
                    starts.append(start)
                    start += n
                yield pa.record_batch([pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), rows.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["part", "start_in_part", "doc_id", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, continues, sequence_length, padded_length."""
    tokens = staged(tokenized(docs, tokenizer_path, end_id), "tokens")
    totals = dict(tokens.groupBy("part").agg(F.sum("doc_tokens")).collect())  # two numbers for each input partition
    bases, total = [None] * (max(totals, default=-1) + 1), 0
    for part in sorted(totals):
        bases[part], total = total, total + totals[part]
    base = F.get(F.from_json(F.lit(json.dumps(bases)), "array<bigint>"), F.col("part"))
    placed = tokens.withColumn("begin", base + F.col("start_in_part")).withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("begin") / length), F.floor((F.col("begin") + F.col("doc_tokens") - 1) / length))))
    first = F.col("sequence_id") * length  # the window's first place in the stream
    start = F.greatest(F.lit(0).cast("bigint"), first - F.col("begin"))
    end = F.least(F.col("doc_tokens"), first + length - F.col("begin"))
    cut = placed.withColumns({"start": start, "length": end - start, "offset": F.col("begin") + start - first})
    ids = F.substring(F.col("ids"), (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    filled = F.least(F.lit(length).cast("bigint"), F.lit(total).cast("bigint") - first)
    return cut.select(
        "doc_id", "start", "length", ids.alias("ids"), "doc_tokens", "sequence_id", "offset",
        (F.col("start") + F.col("length") < F.col("doc_tokens")).alias("continues"), filled.alias("sequence_length"),
        F.when(F.bit_count(filled) == 1, filled).otherwise(F.lit(length).cast("bigint")).alias("padded_length"),
    )
