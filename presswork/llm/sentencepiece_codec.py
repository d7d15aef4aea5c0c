"""SentencePiece encoding and decoding with offsets kept.

A model file carries a compiled character map: a double-array trie from byte
prefixes to replacement strings. `Normalizer` walks the text, takes the longest
prefix that the trie knows (else one character), and records for every byte it
writes the source byte it came from. Pieces are cut from the normalised text,
so their byte lengths add up to positions in it, and the recorded alignment
projects every piece back to a span of the original UTF-8 bytes.

Merges are found on chunks, not on whole texts: in a vocabulary where no piece
has a word mark after another character, no merge crosses the place before one; the
same holds between a letter and ASCII punctuation, a digit or white space, but for
those letters that the vocabulary shows before one (read when a model is loaded). Each distinct chunk is
encoded once and kept in a cache that takes no more entries when it is full.
With another vocabulary the chunk is the whole text.

Nulls and empty texts give only the end id, no spans, and decode to "".
Repeated rows and ids are kept, each row is encoded on its own; extra columns
are not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, documents, fresh, map_text

MARK = "▁"
CACHE_ENTRIES = 100_000
CACHED_CHARS = 32
#: Characters before which a chunk may end; all others but the mark count as letters here.
BREAKS = r"\x00-\x40\x5B-\x60\x7B-\x7F"

CODED = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("begins", T.ArrayType(T.LongType(), False)),
        T.StructField("ends", T.ArrayType(T.LongType(), False)),
        T.StructField("decoded", T.StringType()),
    ]
)
DIGEST = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("n_bytes_spanned", T.LongType()),
        T.StructField("spans_sha256", T.StringType()),
    ]
)


class CharMap:
    """The compiled map: little-endian trie size, trie units, then replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.units: np.ndarray | None = None
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            if size % 4 or size + 4 > len(blob):
                raise ValueError("broken compiled character map")
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of data[at:]."""
        units, found = self.units, None
        place, unit = 0, int(units[0])
        place ^= self._offset(unit)
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units):
                break
            unit = int(units[place])
            if unit & 0x800000FF != data[i]:  # the label of a leaf never fits
                break
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                start = int(units[place]) & 0x7FFFFFFF
                found = i + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    """Text to the bytes that pieces are cut from, with the source offset of each byte."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        if not spec.escape_whitespaces:
            raise ValueError("models that do not escape white space are not supported")

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and len(bytes) + 1 source offsets."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.map.units is None and not self.squeeze:
            return self._identity(text, data)
        return self._mapped(data)

    def _identity(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        norm = (MARK if self.prefix else "") + text.replace(" ", MARK)
        source = np.frombuffer(data, np.uint8)
        width = np.where(source == 32, 3, 1)
        at = np.repeat(np.arange(len(source)), width)
        lead = np.zeros(3 if self.prefix else 0, np.int64)
        return norm, np.concatenate([lead, at, [len(source)]])

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        mark, out, offsets, at = MARK.encode(), bytearray(), [], 0
        pieces = []
        while at < len(data):
            hit = self.map.longest(data, at) if self.map.units is not None else None
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = n, data[at : at + n]
            pieces.append((at, hit[1]))
            at += hit[0]
        if self.squeeze:
            first = next((i for i, p in enumerate(pieces) if p[1].strip(b" ")), len(pieces))
            pieces = pieces[first:]
        if not pieces:
            return "", np.zeros(1, np.int64)
        end = len(data)
        if self.prefix:
            out += mark
            offsets += [pieces[0][0]] * 3
        spaced = self.squeeze
        for start, new in pieces:
            while spaced and new[:1] == b" ":
                new = new[1:]
            for byte in new:
                if byte == 32:
                    out += mark
                    offsets += [start] * 3
                else:
                    out.append(byte)
                    offsets.append(start)
            spaced = self.squeeze and (new[-1:] == b" " if new else spaced)
        if self.squeeze:
            while out.endswith(mark):
                del out[-3:]
                end = offsets[-3]
                del offsets[-3:]
        return out.decode("utf-8", "replace"), np.array([*offsets, end], np.int64)


class Codec:
    """A model file, its normaliser, and a cache of encoded chunks; one per Python worker."""

    _open: dict[str, Codec] = {}

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = proto.ModelProto.SentencePiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = Normalizer(model.normalizer_spec)
        self.end = self.sp.eos_id()
        self.widths = np.array(
            [1 if p.type == kind.BYTE else 0 if p.type == kind.CONTROL else len(p.piece.encode()) for p in model.pieces]
        )
        plain = [p.piece for p in model.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED)]
        self.exact = model.trainer_spec.byte_fallback and model.normalizer_spec.add_dummy_prefix
        # Chunks are fed back through the library, so its own normaliser must leave them alone.
        self.chunked = (
            self.exact
            and not model.normalizer_spec.precompiled_charsmap
            and not model.normalizer_spec.remove_extra_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(MARK in p.lstrip(MARK) for p in plain)
        )
        # Marks, then breaks, then letters: cut before a mark, and after letters but those that a piece has before a break.
        bound = {x[0] for p in plain for x in re.findall(f"(?=([^{BREAKS}{MARK}][{BREAKS}]))", p)}
        self.chunked = self.chunked and "a" not in bound
        run = f"[{BREAKS}]*[^{BREAKS}{MARK}]*"
        more = f"(?:(?<=[{re.escape(''.join(sorted(bound)))}])[{BREAKS}]+[^{BREAKS}{MARK}]*)*" if bound else ""
        self.find = re.compile(f"{MARK}*{run}{more}").findall
        self.cache: dict[str, str] = {}

    @classmethod
    def of(cls, model: str) -> Codec:
        """The codec of a model: a path that this worker can open, a file given to all workers, or the name of a public tokenizer."""
        if model not in cls._open:
            cls._open[model] = cls(located(model))
        return cls._open[model]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], list[np.ndarray]]:
        """Ids without the end id, the same in decimal, and the alignments of the texts."""
        normed = [self.normalize(t) for t in texts]
        aligned = [a for _, a in normed]
        if not self.chunked:
            ids = self.sp.encode(texts, num_threads=1)
            return [np.array(x, np.int64) for x in ids], [" ".join(map(str, x)) for x in ids], aligned
        known, said = self.cache, []
        chunks = [self.find(n) for n, _ in normed]
        new = set().union(*chunks).difference(known)
        new.discard("")  # the match at the end of a text
        once = self._encode_chunks(new)
        room = CACHE_ENTRIES - len(known)
        known.update((c, once[c]) for c in islice((c for c in once if len(c) <= CACHED_CHARS), max(0, room)))
        once[""] = ""
        for text, one in zip(texts, chunks):
            parts = [known[c] if c in known else once.get(c) for c in one]
            if None in parts:  # a chunk that can't be told from its neighbours
                parts = list(map(str, self.sp.encode(text)))
            said.append(" ".join(parts).rstrip())
        return [np.fromstring(x, np.int64, sep=" ") for x in said], said, aligned

    def _encode_chunks(self, new: set[str]) -> dict[str, str]:
        """Encode distinct chunks, many at a time, and cut the ids at the chunk ends.

        What starts with a mark can stand behind anything but a mark, what starts with
        a break only behind a letter; the carrier is put there to hold that.
        The library puts the mark that starts each group back as its dummy prefix.
        """
        carrier, groups, size = f"{MARK}a", [[]], 0
        for c in new:
            if c.endswith(MARK):
                groups.insert(0, [c])
                continue
            if size > 4000:
                groups.append([])
                size = 0
            if not c.startswith(MARK):
                groups[-1].append(carrier)
            groups[-1].append(c)
            size += len(c)
        once = {}
        for group in groups:
            if not group:
                continue
            # the library adds no prefix to an empty text
            ids = [self.sp.piece_to_id(MARK)] if group == [MARK] else self.sp.encode("".join(group)[1:])
            stops = np.cumsum(self.widths[np.asarray(ids, np.int64)])
            ends = np.cumsum([len(c.encode()) for c in group])
            at = np.searchsorted(stops, ends)
            if at[-1] == len(stops) or not np.array_equal(stops[at], ends):
                continue  # a piece crosses a chunk end: texts with these chunks are encoded whole
            words, start = list(map(str, ids)), 0
            for c, stop in zip(group, (at + 1).tolist()):
                once[c] = " ".join(words[start:stop])
                start = stop
        return once

    def spans(self, ids: np.ndarray, aligned: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans of the pieces; the library's own ones if the pieces do not cover what this normaliser made."""
        stops = np.cumsum(self.widths[ids])
        if len(stops) and stops[-1] != len(aligned) - 1:
            bytes_before = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
            pieces = self.sp.encode(text, out_type="immutable_proto").pieces
            return bytes_before[[x.begin for x in pieces]], bytes_before[[x.end for x in pieces]]
        starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        return aligned[starts], aligned[stops]


def sp_encode(
    df: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "coded"
) -> DataFrame:
    """`keep` columns and a struct `out` of ids (end id last), byte spans of the ids, and the decoded text; renamed on a clash.

    The end id has the empty span at the end of the text.
    """
    out = fresh(out, keep)

    def run(texts: list[str | None]) -> dict[str, list]:
        codec, texts = Codec.of(model), [t or "" for t in texts]
        ids, _, aligned = codec.encode(texts)
        spans = [codec.spans(*x) for x in zip(ids, aligned, texts)]
        full = [[*i.tolist(), codec.end] for i in ids]
        ends = [len(t.encode()) for t in texts]
        return {
            "ids": full,
            "begins": [[*b.tolist(), n] for (b, _), n in zip(spans, ends)],
            "ends": [[*e.tolist(), n] for (_, e), n in zip(spans, ends)],
            "decoded": codec.sp.decode(full, num_threads=1) if full else [],
        }

    return map_text(df, text_col, run, CODED, keep, out)


def sp_digest(
    df: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "coded"
) -> DataFrame:
    """As `sp_encode`, but digests in place of the arrays, so that they never leave the worker.

    `spans_sha256` is that of begin and end of every piece, as little-endian 64-bit numbers.
    """
    out = fresh(out, keep)

    def run(texts: list[str | None]) -> dict[str, list]:
        codec, texts = Codec.of(model), [t or "" for t in texts]
        ids, said, aligned = codec.encode(texts)
        covered, placed = [], []
        for x in zip(ids, aligned, texts):
            begins, ends = codec.spans(*x)
            covered.append(int((ends - begins).sum()))
            placed.append(hashlib.sha256(np.stack([begins, ends], 1).astype("<i8").tobytes()).hexdigest())
        ids = [[*i.tolist(), codec.end] for i in ids]
        decoded = codec.sp.decode(ids, num_threads=1) if ids else []
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return {
            "n_tokens": [len(i) for i in ids],
            "ids_sha256": [sha(f"{s} {codec.end}" if s else str(codec.end)) for s in said],
            "decoded_sha256": [sha(d) for d in decoded],
            "n_bytes_spanned": covered,
            "spans_sha256": placed,
        }

    return map_text(df, text_col, run, DIGEST, keep, out)


MODEL = "piece_bpe_32k.model"


def located(model: str) -> str:
    """Where this machine has a model: at its path, among the files given to all workers, or with the public tokenizers."""
    if os.path.exists(model):
        return model
    from pyspark import SparkFiles

    try:
        given = SparkFiles.get(os.path.basename(model))
    except Exception:  # outside a job nothing was given
        given = ""
    if os.path.exists(given):
        return given
    import public_tokenizers

    return public_tokenizers.path(model)


def default_model() -> str:
    """The public 32k piece model; each worker finds its own copy."""
    return MODEL


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sp_digest(documents(spark, sf_dir), default_model())
    return coded.select(col("doc_id"), *[F.col("coded")[f.name].alias(f.name) for f in DIGEST])
