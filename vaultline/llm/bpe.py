"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches (operator 8)."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

#: White space but for the blank.
WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
#: Entries of a worker's memory of words; at this size it starts anew. Between tasks a worker keeps KEPT at most.
MEMORY, KEPT = 800_000, 200_000


@lru_cache(1)
def byte_chars() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def from_ranks(path: str):
    """A tokenizers.Tokenizer that merges by the ranks of a rank file.

    Rank files name only the results of merges. Every split of a token into two tokens becomes a merge with the
    token's rank, so that any adjacent pair that forms the token is merged when its turn comes.
    """
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_chars()
    text = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        splits = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        splits.sort(key=lambda x: (ranks[x[0]], ranks[x[1]]))
        merges += [(text[a], text[b]) for a, b in splits]
    t = Tokenizer(models.BPE({text[k]: v for k, v in ranks.items()}, merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return t


@lru_cache(2)
def from_json(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id. What isn't written in characters of the byte table stands for its own UTF-8."""
    back = {c: b for b, c in byte_chars().items()}
    vocab = tokenizer.get_vocab()
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        pieces[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return pieces


class WordEncoder:
    """Encodes texts by a byte-level tokenizer, remembering words.

    The split pattern never joins what stands before a single blank with what follows it, if neither neighbour of
    the blank is white space; so a text can be encoded word by word (each with the blank before it) and every
    distinct word once. Texts with other white space next to a blank, or at either end, go whole, and so do those that
    hold the string of a token that the tokenizer file adds to its vocabulary: the library cuts such texts there.
    """

    def __init__(self, tokenizer) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.memory = tokenizer, {}
        tokenizer.model._resize_cache(0)  # words are remembered here
        self.lengths = np.array([len(p) for p in token_bytes(tokenizer)], np.int64)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def _words(self, text: str) -> list[str]:
        """The words between blanks, or the text as a whole."""
        odd = text[0].isspace() or text[-1].isspace() or "  " in text or any(t in text for t in self.added)
        if odd or any(c in text and (f" {c}" in text or f"{c} " in text) for c in WHITE):
            return [text]
        return text.split(" ")

    def _encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with the blank before them: joined, encoded together and cut by the lengths of their tokens."""
        parts, alone = [words[i : i + 500] for i in range(0, len(words), 500)], []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.cumsum(self.lengths[ids])
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            cut = np.searchsorted(at, ends)
            if not np.array_equal(at[np.minimum(cut, len(at) - 1)], ends):
                alone += part
                continue
            raw, cut = ids.tobytes(), ((cut + 1) * 4).tolist()
            for w, a, b in zip(part, [0, *cut], cut, strict=False):
                yield w, raw[a:b]
        yield from zip(alone, self._encode_whole([" " + w for w in alone]), strict=True)

    def _encode_whole(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 4096):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def rest(self) -> None:
        """Called at a task's end: an idle worker holds a small memory."""
        if len(self.memory) > KEPT:
            self.memory = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        memory, rest = self.memory, [self._words(t) if t else [""] for t in texts]
        first = list(self._encode_whole([words.pop(0) for words in rest]))
        new = set().union(*rest).difference(memory)
        memory.update(self._encode_words(list(new)))
        out = [a + b"".join(map(memory.__getitem__, words)) for a, words in zip(first, rest, strict=True)]
        for w in new:
            if len(w) > 48:
                del memory[w]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file: a rank file (.tiktoken) or a tokenizer file (.json)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(from_ranks(path) if path.endswith(".tiktoken") else from_json(path))
    return _ENCODERS[path]


class Decoder:
    """Ids to bytes and text by the reversed byte table."""

    def __init__(self, tokenizer) -> None:
        self.pieces = token_bytes(tokenizer)

    def raw(self, ids: bytes) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, ids: bytes, text: str) -> tuple[list[int], list[int]]:
        """First and end character of each id. A token that holds part of a character counts the whole character."""
        lengths = np.fromiter((len(self.pieces[i]) for i in np.frombuffer(ids, "<u4").tolist()), np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        data = np.frombuffer(text.encode(), np.uint8)
        lead = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to and with each byte
        first = lead[starts] - 1 if len(starts) else starts
        last = lead[ends - 1] if len(ends) else ends
        return first.tolist(), last.tolist()


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(encoder(path).tokenizer)


def slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """`batch` in pieces of about so many bytes of text, one very long text at least."""
    start = total = 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if total and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(batch):
        yield batch.slice(start)


def encode(docs: DataFrame, path: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """`docs` with ids (binary, little-endian unsigned 32-bit) and, if asked for, char_start and char_end arrays.

    Null and empty texts get empty ids. Existing columns of these names are replaced; others stay.
    """
    new = "ids binary" + (", char_start array<int>, char_end array<int>" if offsets else "")
    kept = docs.drop("ids", "char_start", "char_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in slices(whole, text):
                texts = [t or "" for t in b.column(text).to_pylist()]
                ids = enc.encode(texts)
                arrays = [*b.columns, pa.array(ids, pa.binary())]
                names = [*b.schema.names, "ids"]
                if offsets:
                    spans = [decoder(path).offsets(i, t) for i, t in zip(ids, texts, strict=True)]
                    arrays += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                    names += ["char_start", "char_end"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(kept, run, f"{ddl(kept)}, {new}")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`tokens` with decoded (binary, the exact bytes) and decoded_text (malformed bytes become U+FFFD)."""
    kept = tokens.drop("decoded", "decoded_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = decoder(path)
        for whole in batches:
            for b in slices(whole, ids):
                raw = [dec.raw(i or b"") for i in b.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw])],
                    [*b.schema.names, "decoded", "decoded_text"],
                )

    return map_arrow(kept, run, f"{ddl(kept)}, decoded binary, decoded_text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass over the texts: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty, which has no ids. Rows are kept one for one, repeated ones and null ids included;
    other columns are not read. A very long text takes memory in proportion to its own length only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoder(path), decoder(path)
        for whole in batches:
            for b in slices(whole, "text"):
                ids = enc.encode([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                        pa.array([hashlib.sha256(dec.raw(i)).hexdigest() for i in ids]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        enc.rest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
