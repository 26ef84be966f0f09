"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies.

A task's documents share a vocabulary, begun anew once it has VOCABULARY pre-tokens; blocks of them keep their frequencies
as a sparse matrix (documents x the vocabulary). Only vocabularies take part in the join, each cut into a row for every
fragment of the hash space, so that a pre-token of every document counts once a vocabulary and rows grow with tasks, not
with blocks. Token ids are never kept: the tokenizer is asked for the number of pieces of each distinct pre-token of the
whole corpus, once.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netmetrics.llm import common as c

#: Fixed by byte-level BPE: how the tokenizers library cuts a text before it looks for pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text of a block, and pre-tokens from which on a vocabulary takes no further block.
BLOCK, VOCABULARY = 8 << 20, 200_000
COUNT_LIMIT = 1024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _latin() -> tuple[re.Pattern, re.Pattern]:
    """PATTERN with its classes written out for code points under U+0180, and what finds a text with any other.

    The standard library's engine is several times faster with plain classes than with properties.
    """
    points = [chr(x) for x in range(0x180)]
    letter, digit, space = ({x for x in points if regex.match(p, x)} for p in (r"\p{L}", r"\p{N}", r"\s"))

    def listed(chars: set[str]) -> str:
        return "[" + "".join(f"\\u{ord(x):04x}" for x in sorted(chars)) + "]"

    other, blank, solid = listed(set(points) - letter - digit - space), listed(space), listed(set(points) - space)
    parts = ("'(?:[stmd]|re|ve|ll)", f" ?{listed(letter)}+", f" ?{listed(digit)}+", f" ?{other}+", rf"{blank}+(?!{solid})", f"{blank}+")
    return re.compile("|".join(parts)), re.compile("[^\\u0000-\\u017f]")


class Splitter:
    """Cuts texts into pre-tokens as the tokenizer does; an added token's string is a pre-token of its own."""

    def __init__(self, path: str) -> None:
        with open(path) as f:
            conf = json.load(f)
        pre = conf["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or conf["normalizer"] or conf["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE without normalizer or prefix space is asked for")
        self.added = [x["content"] for x in conf["added_tokens"]]
        self.general = regex.compile(PATTERN).findall
        latin, beyond = _latin()
        self.latin, self.beyond = latin.findall, beyond.search
        self.cut = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.added, key=len, reverse=True))).split if self.added else None

    def find(self, text: str) -> list[str]:
        return self.latin(text) if text.isascii() or not self.beyond(text) else self.general(text)

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(x in text for x in self.added):
            return self.find(text)
        out: list[str] = []
        for part in self.cut(text):
            if part:
                out += [part] if part in self.added else self.find(part)
        return out


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: the byte's own, or one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class Pieces:
    """The ids of one pre-token, by the tokenizers library's model."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        self.model, self.letters = tool.model, _byte_letters()
        self.added = {str(t): k for k, t in ((k, t.content) for k, t in tool.get_added_tokens_decoder().items())}

    def __call__(self, pretoken: str) -> list[int]:
        if pretoken in self.added:
            return [self.added[pretoken]]
        return [t.id for t in self.model.tokenize(pretoken.encode("utf-8", "replace").decode("latin-1").translate(self.letters))]


class Places(dict):
    """pre-token -> its number, by first use."""

    def __missing__(self, pretoken: str) -> int:
        out = self[pretoken] = len(self)
        return out


def _planes(x: np.ndarray, pack) -> bytes:
    """32-bit numbers, compressed byte plane by byte plane."""
    return pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _blocks(path: str, fragments: int):
    """A row for each block with its matrix (fragment MATRIX); for each vocabulary a row with the order in which fragments hold
    its numbers (fragment ORDER), and one for each fragment with the pre-tokens it has there."""

    def rows(kind: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*kind, strict=True), types, strict=True)], ["vocabulary", "fragment", "words", "doc_ids", "n_bytes", "row_sizes", "matrix"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pack, none, nil = Splitter(path), zstandard.ZstdCompressor(level=1).compress, None, np.zeros(0, np.int64)
        name, place = uuid.uuid4().hex, Places()

        def ended() -> pa.RecordBatch:
            words = list(place)
            to = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words), np.uint64, len(words)) % np.uint64(fragments)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(fragments + 1))
            out = [(name, ORDER, _planes(order, pack), none, none, none, none)]
            for f in np.flatnonzero(np.diff(cut)).tolist():
                own = [words[i] for i in order[cut[f] : cut[f + 1]]]
                out.append((name, f, _framed([pack("".join(own).encode("utf-8", "replace")), _planes(np.array([*map(len, own)]), pack)]), none, none, none, none))
            return rows(out)

        for b in c.blocks(batches, limit=BLOCK):
            number = place.__getitem__
            cols, counts, ends, sizes = [], [], [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                sizes.append(len(text.encode("utf-8", "replace")))
                ids = np.fromiter(map(number, split(text)), np.int32)
                own, n = np.unique(ids, return_counts=True)
                cols.append(np.diff(own, prepend=0))
                counts.append(n)
                ends.append(len(own))
            matrix = pack(_framed([_planes(x, pack) for x in (np.concatenate([*cols, nil]), np.concatenate([*counts, nil]))]))
            yield rows([(name, MATRIX, none, b.column("doc_id").to_pylist(), sizes, ends, matrix)])
            if len(place) >= VOCABULARY:
                yield ended()
                name, place = uuid.uuid4().hex, Places()
        if place:
            yield ended()

    return scan


def _framed(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _unframed(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


MATRIX, ORDER = -1, -2
BLOCK_SCHEMA = "vocabulary string, fragment int, words binary, doc_ids array<long>, n_bytes array<long>, row_sizes array<long>, matrix binary"


def _pieces(path: str):
    """Fragment by fragment (rows come sorted): the pieces of each distinct pre-token, once, for all vocabularies that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, pack, unpack = Pieces(path), zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor()
        known: dict[str, int] = {}
        at = None
        for b in batches:
            out = []
            for f, raw in zip(b.column("fragment").to_pylist(), b.column("words").to_pylist(), strict=True):
                if f != at:
                    at, known = f, {}
                joined, lengths = _unframed(raw)
                joined, ends = unpack.decompress(joined).decode(), np.cumsum(_numbers(lengths)).tolist()
                words = [joined[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
                for w in words:
                    if w not in known:
                        known[w] = len(pieces(w))
                out.append(_planes(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), pack))
            yield pa.RecordBatch.from_arrays([b.column("vocabulary"), b.column("fragment"), pa.array(out, pa.binary())], ["vocabulary", "fragment", "pieces"])

    return count


def token_counts(documents: DataFrame, path: str | None = None, limit: int = COUNT_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of documents; null and empty texts have no bytes and tokens.

    Repeated rows, and rows without a doc_id, each give a row; a very long text is a block of its own, and its vocabulary as
    long as it makes it; an empty table gives none. The tokenizer's file must be at ``path`` on every machine.
    """
    path, spark = path or default_path(), documents.sparkSession
    folder = c.shared_dir(spark)
    df = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    fragments = c.partitions(spark)
    made = c.written(df.mapInArrow(_blocks(path, fragments), BLOCK_SCHEMA), folder, "blocks")
    words = made.where("fragment >= 0").select("vocabulary", "fragment", "words")
    pieces = words.repartition(fragments, "fragment").sortWithinPartitions("fragment").mapInArrow(_pieces(path), "vocabulary string, fragment int, pieces binary")
    order = made.where(F.col("fragment") == ORDER).select("vocabulary", "fragment", F.col("words").alias("pieces"))
    back = pieces.unionByName(order).groupBy("vocabulary").agg(F.array_sort(F.collect_list(F.struct("fragment", "pieces"))).alias("found"))
    matrix = made.where(F.col("fragment") == MATRIX).drop("fragment", "words")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, n_pieces = None, np.zeros(0, np.int64)  # rows of a vocabulary follow one another
        for b in batches:
            for i in range(b.num_rows):
                sizes = b.column("row_sizes")[i].values.to_numpy()
                cols, counts = map(_numbers, _unframed(unpack.decompress(b.column("matrix")[i].as_py())))
                if (name := b.column("vocabulary")[i].as_py()) != last:
                    last, found = name, b.column("found")[i].as_py() or []
                    own = [_numbers(x["pieces"]) for x in found]  # the order first
                    n_pieces = np.zeros(len(own[0]) if own else 0, np.int64)
                    if own:
                        n_pieces[own[0]] = np.concatenate(own[1:])
                ends = np.cumsum(sizes)
                begin = ends - sizes
                run = np.cumsum(cols)  # differences begin anew with each document
                before = np.concatenate([[0], run])[begin]
                value = n_pieces[run - np.repeat(before, sizes)] * counts if len(run) else run
                sums = np.concatenate([[0], np.cumsum(value)])
                n = sums[ends] - sums[begin]
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[i].values, b.column("n_bytes")[i].values, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return matrix.join(back, "vocabulary", "left").mapInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
