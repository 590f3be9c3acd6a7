"""Byte-level BPE encoding and decoding (operator 10): each distinct word is encoded once.

Documents are taken in blocks of bounded size. A block is exploded into its distinct words and,
for each document, the positions of those words as numbers. The words of all blocks meet in one
shuffle by word slot, where each distinct word is encoded once; its ids go back to the
blocks that have it, and there every document is put together again by position. All
rows carry packed arrays. Nothing that grows with the data is broadcast, no group is larger than
a block, and a word meets its slot at most once a block, however often it occurs.

Words and positions of a block come from two readings of it, as the positions then move once only;
both carry a mark of the block's words, and blocks that don't agree raise an error.

A "word" is a stretch of text which the pattern always cuts out whole: a run of characters other
than white space with the single space before it, or a longer run of white space. The pattern
is then applied within the word, and each match is encoded separately.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import freeing, small_batches, table
from canvass.llm.vocab import read_ranks

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of text in a block (a block has one document at least).
BLOCK_CHARS = 16 << 20
#: Word places in a row that carries documents.
ROW_WORDS = 1 << 16

#: Stored bytes of input to a partition of words or documents, where that makes more than the session's shuffle partitions.
PART_BYTES = 32 << 20

#: White space as the pattern has it (fixed by Unicode).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = regex.compile(rf"[{_SPACE}][{_SPACE}]")
_COARSE = regex.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def cut_words(text: str) -> list[str]:
    """Cut a text where the pattern always cuts: before each space between other characters.

    Without two white-space characters in a row, every space opens a new word.
    """
    if _SPACES.search(text):
        return _COARSE.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words), 3)


def _unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.append(4 + 4 * n, ends[:-1]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _pack_numbers(x: np.ndarray) -> bytes:
    """Byte planes of a uint32 array, compressed; its length is that of the first plane."""
    planes = np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.uint64(len(x)).tobytes() + planes.tobytes(), 3)


def _unpack_numbers(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class Block:
    """Documents of a block, and its words with their numbers in the order in which they first come.

    So frequent words have small numbers, which pack well.
    """

    def __init__(self, name: str):
        self.name, self.chars, self.ids, self.coded, self.index = name, 0, [], [], {}

    def _words(self) -> tuple[list[bytes], int]:
        words = [w.encode("utf-8", "surrogatepass") for w in self.index]
        return words, zlib.crc32(b"\0".join(words))

    def _row(self, slot: int, mark: int, numbers: bytes, words: bytes | None = None, doc_ids: list | None = None) -> dict:
        return {"slot": slot, "block": self.name, "mark": mark, "doc_ids": doc_ids, "words": words, "numbers": numbers}

    def word_rows(self, slots: int) -> Iterator[dict]:
        """The words of each slot in order, and their numbers."""
        words, mark = self._words()
        ordered = sorted((zlib.crc32(w) % slots, w, i) for i, w in enumerate(words))
        for slot, group in groupby(ordered, key=lambda x: x[0]):
            some = list(group)
            numbers = np.fromiter((i for _, _, i in some), np.uint32, len(some))
            yield self._row(slot, mark, _pack_numbers(numbers), _pack_words([w for _, w, _ in some]))

    def document_rows(self, slots: int) -> Iterator[dict]:
        """Documents as numbers of words, about ``ROW_WORDS`` to a row."""
        _, mark = self._words()
        first = size = 0
        for i, codes in enumerate(self.coded):
            size += len(codes)
            if size >= ROW_WORDS or i == len(self.coded) - 1:
                some = self.coded[first : i + 1]
                body = _pack_numbers(np.concatenate([np.fromiter(map(len, some), np.uint32, len(some)), *some]))
                yield self._row(0, mark, body, doc_ids=self.ids[first : i + 1])
                first, size = i + 1, 0


def _pack_ids(found: list[list[int]]) -> bytes:
    """How many ids each word has, and all ids one after the other (words in order share their first ones)."""
    counts = np.fromiter(map(len, found), "<u4", len(found))
    flat = np.fromiter(chain.from_iterable(found), "<u4", int(counts.sum()))
    narrow = flat.astype("<u2") if len(flat) and flat.max() < 1 << 16 else flat
    head = np.array([len(counts), narrow.itemsize], "<u4").tobytes()
    return zstandard.compress(head + counts.tobytes() + narrow.tobytes(), 3)


def _unpack_ids(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, size = np.frombuffer(raw, "<u4", 2)
    counts = np.frombuffer(raw, "<u4", n, 8).astype(np.int64)
    return counts, np.frombuffer(raw, f"<u{size}", offset=8 + 4 * int(n)).astype(np.int32)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def encode(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS, slots: int | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row: whole texts by the rank file at ``path``.

    Each match of ``pattern`` is encoded separately, without special tokens. Null and empty texts
    have an empty array. Repeated rows and null ids keep their rows; other columns of ``docs`` are
    not read; an empty table gives an empty one. ``docs`` is read twice and must come in the
    same order (files and tables do). Partitions grow in number with the stored size of ``docs``, not in size; ``slots``
    is four times their number by default.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(read_ranks(path))
    stored_bytes = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(stored_bytes // PART_BYTES, 1 << 20))
    slots = slots or 4 * parts
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    kind = kind if kind in _ID_TYPES else "string"
    id_type = _ID_TYPES[kind]
    schema = pa.schema([
        ("slot", pa.int32()), ("block", pa.string()), ("mark", pa.int64()), ("doc_ids", pa.list_(id_type)), ("words", pa.binary()), ("numbers", pa.binary())
    ])

    def explode(rows_of, numbers: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, block = 0, Block("")
            for batch in batches:
                for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    block.name, text = f"{part}-{n}", text or ""
                    words, index = cut_words(text), block.index
                    if numbers:
                        block.ids.append(doc_id)
                        block.coded.append(np.array([index.setdefault(w, len(index)) for w in words], np.uint32))
                    else:
                        index.update(dict.fromkeys(words))
                    block.chars += len(text) + 1
                    if block.chars >= block_chars:
                        yield _batch(list(rows_of(block, slots)), schema)
                        n, block = n + 1, Block("")
            if block.chars:
                yield _batch(list(rows_of(block, slots)), schema)

        return freeing(run)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        now, known = None, {}
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if row["slot"] != now:  # rows come in order of slots: what is known stays small
                    now, known = row["slot"], {}
                words = _unpack_words(row["words"])
                for w in words:
                    if w not in known:
                        known[w] = own.encode_ordinary(w.decode("utf-8", "surrogatepass"))
                row["words"] = _pack_ids([known[w] for w in words])
            yield _batch(rows, schema)

    out_schema = pa.schema([("doc_id", id_type), ("ids", pa.list_(pa.int32()))])

    def reassemble(block: pa.Table) -> pa.Table:
        rows = block.to_pylist()
        if len({r["mark"] for r in rows}) > 1:
            raise ValueError("the documents came in another order the second time; write them to a table first")
        found = [(_unpack_numbers(r["numbers"]), *_unpack_ids(r["words"])) for r in rows if r["words"] is not None]
        none = np.zeros(0, np.int64)
        numbers, sizes, flat = (np.concatenate([none, *x]).astype(np.int64) for x in zip(*found)) if found else (none, none, none)
        flat = flat.astype(np.int32)
        counts, starts = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
        counts[numbers], starts[numbers] = sizes, np.cumsum(sizes) - sizes
        of, offsets, ids = [], [np.zeros(1, np.int64)], [flat[:0]]
        for row in rows:
            if row["words"] is not None:
                continue
            body = _unpack_numbers(row["numbers"])
            lengths, codes = body[: len(row["doc_ids"])].astype(np.int64), body[len(row["doc_ids"]) :]
            n = counts[codes]
            ends = np.cumsum(n)
            ids.append(flat[np.repeat(starts[codes] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)])
            offsets.append(offsets[-1][-1] + np.append(0, ends)[np.cumsum(lengths)])
            of += row["doc_ids"]
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int64()), pa.array(np.concatenate(ids)))
        return pa.Table.from_arrays([pa.array(of, id_type), lists.cast(pa.list_(pa.int32()))], schema=out_schema)

    # The partition's number within docs, which is the same wherever that plan is put.
    held = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast(kind), "text")
    columns = f"slot int, block string, mark bigint, doc_ids array<{kind}>, words binary, numbers binary"
    words = held.mapInArrow(explode(Block.word_rows, False), columns)
    coded = words.repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(freeing(encode_words), columns)
    documents = held.mapInArrow(explode(Block.document_rows, True), columns)
    return coded.union(documents).repartition(parts, "block").groupBy("block").applyInArrow(reassemble, f"doc_id {kind}, ids array<int>")


def decoded(tokens: pa.Array, ids: pa.Array) -> pa.Array:
    """The bytes of each list of ids: all tokens are taken at once, one after the other, and cut where lists end."""
    taken = tokens.take(ids.flatten())
    if taken.null_count:
        raise ValueError("an id is unknown or null")
    ends = np.frombuffer(taken.buffers()[1], "<i8", len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    body = memoryview(taken.buffers()[2] or b"") if len(taken) else memoryview(b"")
    sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cuts = ends[np.append(0, np.cumsum(sizes, dtype=np.int64))].tolist()
    named = ids.is_valid().to_pylist()
    return pa.array([bytes(body[i:j]) if is_list else None for i, j, is_list in zip(cuts, cuts[1:], named)], pa.binary())


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids in ``ids``, from the table of tokens at ``path``.

    The table of tokens is the vocabulary file, of bounded size, and is joined by broadcast: its
    tokens are looked up by position. Null ids give null; an unknown id raises an error.
    """
    spark = coded.sparkSession
    ranks = read_ranks(path)
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    sent = spark.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.large_binary())
        for batch in batches:
            yield batch.append_column("decoded", decoded(known, batch.column("ids")))

    return coded.mapInArrow(freeing(run), coded.withColumn("decoded", F.lit(None).cast("binary")).schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    coded = decode(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
