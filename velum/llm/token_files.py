"""Token ids in bit-plane shuffled files.

A file holds the ids of consecutive documents as one stream cut into blocks of ``BLOCK``
ids. A block is transposed into its four byte planes, the first byte of every id, then the
second and so on, and each plane is compressed with zstandard: high planes are nearly
constant, low ones hold what is left. Behind the blocks come the documents (identifier and
number of ids) and the chunk index, with the place and the plane sizes of every block, so
that a reader gets at any block without the ones before.

    "VTOK0001" | planes of block 0 | planes of block 1 | ... | documents | chunk index |
    3 numbers: offset of the documents, of the index, number of blocks | "VTOK0001"

Documents are dealt out by ranges of their identifier and sorted, each task writes one
file, and a manifest written through Spark names the files of the tasks that ended well;
what a lost task left behind is in no manifest."""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.shared import Scratch, col, offsets

MAGIC = b"VTOK0001"
BLOCK = 1 << 16
PLANES = 4
LEVEL = 1
INDEX = np.dtype([("offset", "<i8"), ("n_ids", "<i4"), ("sizes", "<i4", (PLANES,))])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "?"), ("n_ids", "<i8")])
TOKENIZER_LIMIT = 64 << 20
MANIFEST = "part long, path string, n_docs long, n_ids long"
DOCUMENTS = "doc_id long, part long, at long, n_tokens long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """The letter under which a byte-level vocabulary lists each byte: printable ones are
    themselves, the others get the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()
ID = attrgetter("id")


class Words(dict):
    """Ids by word; a word not met before is encoded, and kept unless it is long: long words
    seldom come back."""

    def __init__(self, encode: Callable[[str], bytes], longest: int):
        self.encode, self.longest = encode, longest

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= self.longest:
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian 32-bit numbers.

    The byte-level tokenizer splits a text into pieces by ``PIECES`` and its model encodes
    each by itself, and a blank that a non-blank follows starts a piece. So words are looked up,
    unknown ones are split into pieces, and only unknown pieces go to the library. Both
    tables start anew when they are full. Texts with two blanks in a row, and those that
    hold one of the tokenizer's added tokens, are encoded as they are."""

    # Fixed value: how this family of tokenizers splits a text.
    PIECES = (
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    )
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    MOST_WORDS, MOST_PIECES, LONGEST = 1_000_000, 1_000_000, 40

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = ["  ", *filter(None, added)]
        self.model = self.tokenizer.model
        self.findall = regex.compile(self.PIECES).findall
        self.words = Words(self._word, self.LONGEST)
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        # Printable ASCII is listed as it is; only the blank has another letter.
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", BYTE_LETTERS[32])
        else:
            shown = piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        return self._ids(shown)

    def _ids(self, shown: str) -> bytes:
        return array("I", map(ID, self.model.tokenize(shown))).tobytes()

    def _known(self, piece: str) -> bytes:
        """The ids of a piece, from the table or the library."""
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._piece(piece)
            if len(piece) <= self.LONGEST:
                self.pieces[piece] = ids
        return ids

    def _by_pieces(self, text: str) -> bytes:
        return b"".join(map(self._known, self.findall(text)))

    def _word(self, word: str) -> bytes:
        """The ids of a word behind a blank."""
        # Letters with marks behind them, most words, need no regex; the letters of such a
        # word are seldom in another one, so they go past the table.
        bare = word.rstrip(self.MARKS)
        if not bare.isalpha():
            return self._by_pieces(" " + word)
        if bare.isascii():
            ids = self._ids(BYTE_LETTERS[32] + bare)
        else:
            ids = self._piece(" " + bare)
        return ids if len(bare) == len(word) else ids + self._known(word[len(bare) :])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > self.MOST_WORDS:
            self.words.clear()
        if len(self.pieces) > self.MOST_PIECES:
            self.pieces.clear()
        split = [None if any(a in t for a in self.added) else t.split(" ") for t in texts]
        whole = iter(self.encode([t for t, words in zip(texts, split) if not words]))
        get, out = self.words.__getitem__, []
        for words in split:
            if words:
                first = self._by_pieces(words[0])
                out.append(first + b"".join(map(get, islice(words, 1, None))))
            else:
                out.append(next(whole))
        return out


class Writer:
    """One file of the format."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.rest, self.waiting = [], 0
        self.index, self.documents = [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append((doc_id or 0, doc_id is not None, len(ids) // 4))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 4 * BLOCK:
            data = b"".join(self.rest)
            whole = len(data) - len(data) % (4 * BLOCK)
            for i in range(0, whole, 4 * BLOCK):
                self._block(data[i : i + 4 * BLOCK])
            self.rest, self.waiting = [data[whole:]], len(data) - whole

    def _block(self, data: bytes) -> None:
        planes = np.frombuffer(data, "u1").reshape(-1, PLANES).T
        packed = [self.zstd.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
        self.index.append((self.at, len(data) // 4, [len(p) for p in packed]))
        self._put(b"".join(packed))

    def close(self) -> None:
        if self.waiting:
            self._block(b"".join(self.rest))
        documents = self.at
        self._put(self.zstd.compress(np.array(self.documents, DOCUMENT).tobytes()))
        index = self.at
        self._put(np.array(self.index, INDEX).tobytes())
        self._put(np.array([documents, index, len(self.index)], "<i8").tobytes() + MAGIC)


class Reader:
    def __init__(self, source, size: int):
        self.source = source
        tail = 24 + len(MAGIC)
        last = self._get(size - tail, tail)
        if last[24:] != MAGIC or self._get(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        at, index, n = np.frombuffer(last[:24], "<i8")
        self.index = np.frombuffer(self._get(index, n * INDEX.itemsize), INDEX)
        self.zstd = zstandard.ZstdDecompressor()
        packed = self._get(at, index - at)
        self.documents = np.frombuffer(self.zstd.decompress(packed), DOCUMENT)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(n))

    def block(self, k: int) -> np.ndarray:
        """The ids of block ``k``."""
        entry = self.index[k]
        data, planes, at = self._get(entry["offset"], entry["sizes"].sum()), [], 0
        for size in entry["sizes"]:
            planes.append(np.frombuffer(self.zstd.decompress(data[at : at + size]), "u1"))
            at += int(size)
        return np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents in order with their ids."""
        have, at, k = [np.empty(0, "<u4")], 0, 0
        for doc_id, known, n in self.documents:
            while at < n:
                have.append(self.block(k))
                at, k = at + len(have[-1]), k + 1
            ids = np.concatenate(have) if len(have) > 1 else have[0]
            have, at = [ids[n:]], at - n
            yield (int(doc_id) if known else None), ids[:n]


def _open(uri: str):
    """File system and path of a folder or file."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


ENCODERS: dict[int, Encoder] = {}


def write_token_files(
    df: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Write ``df`` as token files in ``folder``; rows of ``MANIFEST`` for the files.

    ``end_id`` is appended to each document. Null texts are empty; null identifiers come
    first; documents with the same identifier are ordered by the hash of their text. The
    tokenizer's file is read here and goes along with the tasks."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read(TOKENIZER_LIMIT + 1)
    if len(tokenizer) > TOKENIZER_LIMIT:
        raise ValueError("the tokenizer's file is too large to go along with every task")
    tail, key = np.array([end_id], "<u4").tobytes(), zlib.crc32(tokenizer.encode())
    shipped = df.sparkSession.sparkContext.broadcast(tokenizer)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ENCODERS.get(key)
        if encode is None:
            encode = ENCODERS[key] = Encoder(shipped.value)
        part = TaskContext.get().partitionId()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        path, n_docs, n_ids, writer = f"{root}/{part:06d}-{uuid.uuid4().hex}.vtok", 0, 0, None
        for batch in batches:
            # A few texts at a time, so that long ones do not add up.
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                if writer is None:
                    out = store.open_output_stream(path)
                    writer = Writer(out)
                for i, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist())):
                    writer.add(i, ids + tail)
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4 + 1
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]}
            )

    rows = df.select(
        col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text")
    ).withColumns({"mark": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = ("doc_id", "mark", "place")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text").mapInArrow(write, MANIFEST)


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """``DOCUMENTS`` from the files of a manifest: each document with its file, the
    number of ids before it there, its number of ids and their checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        for batch in batches:
            for part, path in zip(batch["part"].to_pylist(), batch["path"].to_pylist()):
                size = store.get_file_info(path).size
                with store.open_input_file(path) as source:
                    rows, at = [], 0
                    for doc_id, ids in Reader(source, size):
                        rows.append((doc_id, part, at, len(ids), zlib.crc32(ids)))
                        at += len(ids)
                names = ("doc_id", "part", "at", "n_tokens", "ids_crc32")
                yield pa.RecordBatch.from_pydict(
                    {n: pa.array(v, pa.int64()) for n, v in zip(names, zip(*rows))}
                )

    files = max(1, manifest.count())
    return manifest.repartitionByRange(files, "part").mapInArrow(read, DOCUMENTS)


def token_files(df: DataFrame, tokenizer_path: str, end_id: int = 2, **columns) -> DataFrame:
    """Write ``df`` to files in the shared folder and read them back: ``doc_id, start,
    n_tokens, ids_crc32`` per document, ``start`` counting the ids of all documents
    before it. An empty table gives no files and no rows; other columns are not read."""
    scratch = Scratch(df.sparkSession)
    folder = f"{scratch.root}/tokens"
    manifest = scratch.keep(write_token_files(df, folder, tokenizer_path, end_id, **columns), "manifest")
    starts = offsets(manifest, "part", "n_ids")
    return (
        read_documents(manifest, folder)
        .join(F.broadcast(starts) if manifest.count() <= 100_000 else starts, "part")
        .select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )
