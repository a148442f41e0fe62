"""Token-ID output: flat unsigned-integer files with 64-bit document offsets.

A data set is a folder of parts and a manifest.  A part's files have one stem:
``.bin`` (ids, little-endian uint16, or uint32 for larger vocabularies),
``.off`` (n + 1 little-endian int64 offsets in ids, from 0) and ``.doc`` (n
int64 document ids).  The manifest gives each part's stem, how many of its
documents have no id (they are its first), and its base: the number of ids in
all parts before it, a prefix sum over the parts' totals.  Documents ascend by
id over the parts.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import listed, map_batches, materialize, merged, scratch

#: Bytes of text that are encoded together.
SLICE_BYTES = 8_000_000
#: Pieces in one text for the model, and texts that it gets together.
PIECES, TEXTS = 64, 64
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
#: Kinds of bytes.  Letters are those of ASCII and of U+00C0 to U+023F (their lead and following bytes), letters to every Unicode version.
LETTER, DIGIT, MARK, WHITE, SPACE, ODD = range(6)
#: What may follow a space that does not begin a piece: ASCII white space, or the lead byte of other white space.
_AFTER = np.zeros(256, bool)
_AFTER[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and inner path of a URI or absolute local path."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


class Encoder:
    """Whole-text ids, the same as ``encode(text, add_special_tokens=False)``.

    A byte-level pre-tokenizer starts a new piece at each space that stands
    between two non-space characters, so " word" chunks encode independently of
    each other; a chunk of plain characters parts further where the kind of its
    characters changes.  Equal pieces of the texts at hand are encoded once, many
    in one text, and the model gets their bytes' letters with no pattern to match.
    Chunks with other characters go through the whole tokenizer, and so do texts
    with a space before other white space or at an end.
    """

    def __init__(self, path: str, end_id: int):
        self.path, self.tokenizer = path, tokenizer_of(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else np.dtype("<u4")
        self.end_id = end_id
        kind, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        plain = type(kind).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and not getattr(kind, "add_prefix_space", True) and getattr(kind, "use_regex", False)
        self.chunks = plain and not any(t.lstrip or t.rstrip or t.single_word or " " in t.content or not t.content.isascii() for t in added)
        self.kinds = np.full(256, ODD, np.uint8)
        for kinds, of in ((LETTER, [*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]), (DIGIT, range(48, 58)), (WHITE, (9, 10, 13)), (SPACE, (32,))):
            self.kinds[[*of]] = kinds
        self.kinds[[x for x in range(33, 127) if not chr(x).isalnum() and x != ord("'")]] = MARK  # an apostrophe may open a contraction
        for t in added:  # a chunk that holds an added token has this byte of it
            if t.content:
                self.kinds[min(t.content.encode(), key=lambda x: chr(x).isalnum())] = ODD
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.chunks:
            own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 255 and x != 173]
            others = [x for x in range(256) if x not in own]
            #: The letter that stands for each byte in the model; 254 and 255, which no text has, are what pieces are joined by.
            self.letters = np.arange(256, dtype="<u4")
            self.letters[others] = 256 + np.arange(len(others))
            space, self.letters[254] = chr(self.letters[32]), 32
            self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith(space)]] = True
            self.between = self.tokenizer.token_to_id("\xff")

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(got.ids, self.dtype) for got in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def _opened(self, pieces: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by piece: a piece has one space, its first character, so its first id is the only one that opens with a space."""
        counts = np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))
        return (ids, counts) if len(counts) == len(pieces) else self._each(pieces)

    def _joined(self, pieces: list[bytes], by: bytes) -> list[bytes]:
        return [by.join(pieces[at : at + PIECES]) for at in range(0, len(pieces), PIECES)]

    def _each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(pieces)
        return np.concatenate(found), np.array([len(x) for x in found])

    def _spaced(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of " word" chunks of any characters."""
        return self._opened(pieces, np.concatenate(self.encode(self._joined(pieces, b""))))

    def _plain(self, pieces: list[bytes], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of plain pieces that all or none have a space."""
        if not spaced and self.between is None:
            return self._each(pieces)
        joined = self._joined(pieces, b"\xfe") if spaced else [x + b"\xfe\xff" for x in self._joined(pieces, b"\xfe\xff\xfe")]
        texts = [self.letters[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in joined]
        ids = np.concatenate([np.array(got.ids, self.dtype) for got in pieces_of(self.path).encode_batch_fast(texts, add_special_tokens=False)])
        if spaced:
            return self._opened(pieces, ids)
        apart = ids == self.between
        return ids[~apart], np.diff(np.flatnonzero(apart), prepend=-1) - 1

    def pieces(self, text: np.ndarray, offsets: np.ndarray, odd_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start in the bytes of many texts, and where those do that the whole tokenizer must see."""
        kind, filled = self.kinds[text], offsets[:-1][np.diff(offsets) > 0]
        kind[:-1][(text[:-1] == 0xC3) & ((text[1:] == 0x97) | (text[1:] == 0xB7))] = ODD  # times and division signs
        start, chunk = np.zeros(len(text) + 1, bool), kind == SPACE
        for i in np.flatnonzero(odd_texts):
            chunk[offsets[i] : offsets[i + 1]] = False
            kind[offsets[i]] = ODD
        chunk[filled] = True
        start[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        start[:-1] |= chunk
        # Of several white characters before a word without a space, the last is a piece of its own.
        after = np.append(kind[1:], ODD)
        after[filled[1:] - 1] = WHITE
        after[-1] = WHITE
        start[:-1] |= (kind == WHITE) & (after != WHITE) & (after != SPACE)
        whole = np.empty(0, np.int64)
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            chunks = np.flatnonzero(chunk)
            which = np.unique(np.searchsorted(chunks, odd, "right") - 1)
            whole, ends = chunks[which], np.append(chunks, len(text))[which + 1]
            inside = np.zeros(len(text) + 1, np.int8)
            inside[whole] = 1
            inside[ends] -= 1
            start[:-1] &= (np.cumsum(inside[:-1], dtype=np.int8) == 0) | chunk
        return np.flatnonzero(start), whole

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each with the end id behind it, and their number by text."""
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        text = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not self.chunks or not len(text):
            ids = [np.append(x, self.dtype.type(self.end_id)) for x in self.encode([x.as_buffer().to_pybytes() for x in texts])]
            return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
        odd_texts, spaces = np.zeros(len(texts), bool), np.flatnonzero(text == 32)
        after = np.append(text, 32)[spaces + 1]
        ended = np.zeros(len(text) + 1, bool)
        ended[offsets] = True
        for i in np.unique(np.searchsorted(offsets, spaces[ended[spaces + 1] | _AFTER[after]], "right") - 1):
            odd_texts[i] = bool(_ODD_SPACE.search(texts[int(i)].as_py()))
        starts, whole = self.pieces(text, offsets, odd_texts)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(text))), pa.py_buffer(text)]).dictionary_encode()
        at, distinct = found.indices.to_numpy(), listed(found.dictionary)
        odd = np.zeros(len(distinct), bool)
        odd[at[np.searchsorted(starts, whole)]] = True
        groups: list[list[int]] = [[], [], [], []]
        for i, (piece, special) in enumerate(zip(distinct, odd.tolist(), strict=True)):
            spaced = piece[0] == 32
            groups[(spaced and not _ODD_SPACE.search(piece.decode())) + 2 if special else spaced].append(i)
        ids, counts, first, seen = [], np.ones(len(distinct) + 1, np.int64), np.zeros(len(distinct) + 1, np.int64), 0
        for group, way in zip(groups, (lambda x: self._plain(x, False), lambda x: self._plain(x, True), self._each, self._spaced), strict=True):
            for k in range(0, len(group), PIECES * TEXTS):
                some = group[k : k + PIECES * TEXTS]
                got, n = way([distinct[i] for i in some])
                ids.append(got)
                counts[some], first[some] = n, seen + np.cumsum(n) - n
                seen += len(got)
        ids, first[-1] = np.concatenate([*ids, np.array([self.end_id], self.dtype)]), seen
        # The end is one more piece behind each text's.
        of_text = np.searchsorted(starts, offsets[1:])
        at = np.insert(at, of_text, len(distinct))
        n = counts[at]
        ends = np.cumsum(n)
        shift = first[at] - ends + n
        total = int(ends[-1])
        if max(total, len(ids)) < 1 << 31:
            shift = shift.astype(np.int32)
        place = np.repeat(shift, n)
        place += np.arange(total, dtype=place.dtype)
        return ids[place], np.diff(ends[of_text + np.arange(len(texts))], prepend=0)

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as bytes."""
        ids, counts = self.encoded(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    """One tokenizer for all tasks of a Python worker; it is not changed."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def pieces_of(path: str):
    """The same model for texts whose pieces are parted by spaces and spelt in the model's letters."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    found = Tokenizer.from_str(tokenizer_of(path).to_str())
    found.pre_tokenizer = WhitespaceSplit()
    return found


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, parts: int | None = None) -> DataFrame:
    """Write the data set and return its manifest: part, stem, n_docs, n_nulls, n_tokens, first_id, width, base.

    Documents are range-partitioned by id and encoded where their part is written.
    A part's files are named by part and attempt, and the manifest names those of
    the attempt that counted, so a repeated task neither moves nor overwrites a
    file; what a lost attempt wrote is never read.  Null texts are empty.  Null ids
    come first; repeated ids stay together, in an order fixed by their texts; an
    empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    width = Encoder(tokenizer_path, end_id).dtype.itemsize
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = texts.repartitionByRange(*([parts] if parts else []), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, (fs, root) = context.partitionId(), filesystem(folder)
        stem = f"{part}-{context.taskAttemptId()}"
        docs_seen, offsets, total, nulls, out, encoder = [], [0], 0, 0, None, Encoder(tokenizer_path, end_id)
        for batch in merged(batches, SLICE_BYTES):
            if out is None:
                out = fs.open_output_stream(f"{root}/{stem}.bin")
            ids, counts = encoder.encoded(batch.column(1))
            out.write(ids.tobytes())
            nulls += batch.column(0).null_count
            docs_seen += batch.column(0).fill_null(0).to_pylist()
            offsets += (total + np.cumsum(counts)).tolist()
            total += len(ids)
        if out is None:
            return
        out.close()
        for name, values in (("off", offsets), ("doc", docs_seen)):
            with fs.open_output_stream(f"{root}/{stem}.{name}") as f:
                f.write(np.array(values, "<i8").tobytes())
        row = {"part": part, "stem": stem, "n_docs": len(docs_seen), "n_nulls": nulls, "n_tokens": total, "first_id": docs_seen[nulls] if nulls < len(docs_seen) else None, "width": width}
        yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.string() if k == "stem" else pa.int64()) for k, v in row.items()})

    manifest = materialize(map_batches(ranged, write, "part long, stem string, n_docs long, n_nulls long, n_tokens long, first_id long, width long"), "token-parts")
    # One row for each part, and parts are in the order of the ids: a running sum over parts, not over documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def open_part(fs: pafs.FileSystem, path: str):
    """The bytes of a file: memory-mapped where the file is local, otherwise read whole."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


class Part:
    """Random access to the documents of one part; the first ``nulls`` have no id."""

    def __init__(self, folder: str, stem: str, width: int, base: int = 0, nulls: int = 0):
        fs, root = filesystem(folder)
        self.base, self.nulls = base, nulls
        self.ids = open_part(fs, f"{root}/{stem}.bin").view("<u2" if width == 2 else "<u4")
        self.offsets, self.docs = (open_part(fs, f"{root}/{stem}.{x}").view("<i8") for x in ("off", "doc"))

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read_tokens(spark: SparkSession, folder: str, digest: bool = True) -> DataFrame:
    """Read a data set back: doc_id, start, n_tokens and ids_crc32 (of the ids as uint32), or the ids themselves."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    tasks = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(folder, row["stem"], row["width"], row["base"], row["n_nulls"])
                for at in range(0, len(part), 512):
                    span = range(at, min(at + 512, len(part)))
                    columns = {
                        "doc_id": pa.array([int(part.docs[i]) if i >= part.nulls else None for i in span], pa.int64()),
                        "start": pa.array([part.base + int(part.offsets[i]) for i in span], pa.int64()),
                        "n_tokens": pa.array([int(part.offsets[i + 1] - part.offsets[i]) for i in span], pa.int64()),
                    }
                    if digest:
                        columns["ids_crc32"] = pa.array([zlib.crc32(part[i].astype("<u4").tobytes()) for i in span], pa.int64())
                    else:
                        columns["ids"] = pa.array([part[i].astype("i4") for i in span], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    return map_batches(manifest.select("stem", "n_nulls", "width", "base").repartition(tasks), read, schema)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text; other columns are ignored) and return the digest read back from the files: one row for
    each document, a null or empty text with the end id alone."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, end_id, folder)
    return read_tokens(docs.sparkSession, folder)
