"""Cost-balanced packing of documents into training sequences.

A document's cost is estimated as linear plus quadratic (attention) in its
tokens. Within a window of about a million tokens the documents, in descending
cost, go to the lowest-cost sequence that still has the token capacity for
them; one that fits nowhere whole is cut. The window is cut to whole sequences
(its last tokens wait for the next window), and what is left at a partition's
end goes to sequences whose lengths are powers of two, so nothing is padded.

Each task tokenises and packs its own partition: no shuffle, bounded memory,
and a task that runs again gives the same rows.

Defined cases: a null text is an empty one; every document has at least the
end token; repeated rows are packed once each; null ids are carried; an empty
table gives an empty result; a very long text is tokenised in blocks cut at
white space, where this tokenizer never joins characters.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEQUENCE_TOKENS = 4096
END_ID = 2
WINDOW_TOKENS = 1 << 20
LINEAR_COST = 1.0
QUADRATIC_COST = 1.0 / 4096
CACHE_ENTRIES = 300_000  # words and pieces; BLOCK_CHARS bounds what one text can add
BLOCK_CHARS = 1 << 18

# Texts of these characters alone take the cached path; lower-casing them is
# one to one, they are in normal form C, and their letters are known.
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


class Encoder:
    """Ids of whole texts; the pieces between which the tokenizer never merges are looked up in a bounded cache."""

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(tokenizer_path)
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.bare = Tokenizer.from_str(json.dumps(spec))
        self.bare.encode_special_tokens = True
        self.model = self.bare.model
        self.known: dict[str, bytes] = {}  # words and the pieces they are made of

    def _learn(self, words: set[str]) -> None:
        known, tokenize = self.known, self.model.tokenize
        for word in words:
            pieces = _PIECES.findall(word)
            for piece in pieces:
                if piece in known:
                    continue
                if piece.isascii():  # visible ASCII stands for itself in the byte alphabet, so the merges apply directly
                    known[piece] = b"".join([token.id.to_bytes(4, "little") for token in tokenize(piece)])
                else:
                    ids = self.bare.encode(piece, add_special_tokens=False).ids
                    known[piece] = b"".join([i.to_bytes(4, "little") for i in ids])
            if len(pieces) != 1:
                known[word] = b"".join([known[p] for p in pieces])

    def block(self, text: str) -> bytes:
        """Ids of a text that begins and ends at white space, as little-endian 32-bit numbers."""
        # A literal special token ("<|endoftext|>") is what the tokenizer makes of it; blocks end at white space, so none is cut.
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.lower().split()
        missing = set(words).difference(self.known)
        if missing:
            if len(self.known) + len(missing) > CACHE_ENTRIES:
                self.known.clear()
                missing = set(words)
            self._learn(missing)
        known = self.known
        return b"".join([known[w] for w in words])

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text and the end id."""
        out = []
        at = 0
        while at < len(text):
            end = min(len(text), at + BLOCK_CHARS)
            while end < len(text) and text[end] not in " \n":
                end += 1
            out.append(self.block(text[at:end]))
            at = end
        out.append(END_ID.to_bytes(4, "little"))
        return np.frombuffer(b"".join(out), dtype="<u4")


def _capacities(total: int) -> list[int]:
    """Whole sequences, then the powers of two that make up the rest."""
    full, rest = divmod(total, SEQUENCE_TOKENS)
    return [SEQUENCE_TOKENS] * full + [1 << b for b in range(SEQUENCE_TOKENS.bit_length() - 2, -1, -1) if rest >> b & 1]


def cost(length: float) -> float:
    """Estimated cost of a document (or piece) of so many tokens."""
    return LINEAR_COST * length + QUADRATIC_COST * length * length


def assign(lengths: list[int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """Places of documents in sequences: (document, start, length, sequence).

    Descending documents go to the cheapest sequence with room for them. If
    none has, the roomiest one is filled with the document's first tokens and
    the rest is placed likewise. The capacities add up to the lengths at least.
    """
    room = np.array(capacities, dtype=np.int64)
    spent = np.zeros(len(capacities))
    out = []
    todo = []
    for doc, n in enumerate(lengths):
        # Cutting into whole sequences first: these are the costliest pieces.
        for start in range(0, n, SEQUENCE_TOKENS):
            todo.append((min(SEQUENCE_TOKENS, n - start), doc, start))
    todo.sort(key=lambda x: (-x[0], x[1], x[2]))
    for n, doc, start in todo:
        while n:
            fits = room >= n
            seq = int(np.argmin(np.where(fits, spent, np.inf))) if fits.any() else int(room.argmax())
            part = min(n, int(room[seq]))
            out.append((doc, start, part, seq))
            room[seq] -= part
            spent[seq] += cost(part)
            start, n = start + part, n - part
    return out


def _window_rows(pieces: list[tuple], base: int, with_ids: bool) -> tuple[list[tuple], int]:
    """Rows of one window. pieces: (doc_id, start, ids, doc_tokens)."""
    places = assign([len(p[2]) for p in pieces], caps := _capacities(sum(len(p[2]) for p in pieces)))
    offsets = [0] * len(caps)
    rows = []
    for piece, start, n, seq in places:
        doc_id, first, ids, doc_tokens = pieces[piece]
        part = ids[start:start + n]
        row = (doc_id, first + start, n, zlib.crc32(part.tobytes()), doc_tokens, base + seq, offsets[seq])
        rows.append(row + ((part.astype("int32"),) if with_ids else ()))
        offsets[seq] += n
    return rows, base + len(caps)


_ENCODERS: dict[str, Encoder] = {}


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, if ``with_ids``, the piece's token ids. ``tokenizer_path`` must exist
    on every executor.
    """
    common.small_batches(docs.sparkSession)
    # Ids travel as strings, so null ids don't make floats of the others.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), common.text_of(text_col).alias("text"))
    fields = [rows.schema["doc_id"]] + [
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[f.name for f in schema])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        # Sequence ids of a partition never meet those of another one.
        base = TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = encoder.ids(text)
                pieces.append((doc_id, 0, ids, len(ids)))
                held += len(ids)
                if held < WINDOW_TOKENS:
                    continue
                rest = held % SEQUENCE_TOKENS
                waiting: list[tuple] = []
                while rest:  # the last tokens wait for the next window
                    doc, start, last, n = pieces.pop()
                    cut = max(0, len(last) - rest)
                    waiting.append((doc, start + cut, last[cut:], n))
                    rest -= len(last) - cut
                    if cut:
                        pieces.append((doc, start, last[:cut], n))
                out, base = _window_rows(pieces, base, with_ids)
                yield frame(out)
                pieces = waiting[::-1]
                held = sum(len(p[2]) for p in pieces)
        if pieces:
            yield frame(_window_rows(pieces, base, with_ids)[0])

    out = rows.mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.select(id_col).schema[0].dataType))


def default_tokenizer() -> str:
    """Path of the installed public vocabulary of the contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost-balanced packing of all documents."""
    return pack(common.read_table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)
