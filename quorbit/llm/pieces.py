"""SentencePiece BPE by a table of last tokens.

The encoding of a prefix ends with one token that is the same whatever follows
in the prefix's own encoding, so a table of each prefix's last token holds the
whole encoding. A vocabulary token that ends at a place is the last one there if
the prefix before it ends with a token that the two, merged by themselves, leave
as they are. An automaton finds the tokens that end at each place; ids are
recovered from the end of the table.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorbit.llm.arrow import map_texts
from quorbit.llm.columns import pick

SPACE = "▁"
#: Merges join no character with a following SPACE in such a vocabulary, so these parts are encoded by themselves.
PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Parts, and pairs of tokens, whose results a worker remembers.
REMEMBERED = 400_000


class PieceTable:
    """Encoder and decoder of a BPE model with byte fallback, no normalisation and a dummy prefix."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(names) if lib.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(names) if not special[i] and not lib.is_unused(i)}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        if len(self.byte_id) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.ids) or lib.encode(" Ａ") != lib.encode(f"{SPACE}Ａ"):
            raise ValueError("the model is not a BPE with byte fallback and the identity as its normaliser")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.automaton.add_word(p, (p, len(p), {}))  # with what is known of the tokens that may stand before it
        self.automaton.make_automaton()
        self.surface = [b""] * n  # what an id adds to the decoded text
        for p, i in self.ids.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.surface[i] = bytes([b])
        self.surface[lib.unk_id()] = " ⁇ ".encode()
        self.parts: dict[str, bytes] = {}
        self.n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best pair first, of equal ones the leftmost."""
        held, score = list(text), self.score
        while len(held) > 1:
            best, at = None, -1
            for i in range(len(held) - 1):
                s = score.get(held[i] + held[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            held[at : at + 2] = [held[at] + held[at + 1]]
        return held

    def compatible(self, left: str, right: str, known: dict[str, bool]) -> bool:
        """Whether merging leaves the two tokens apart and whole; an empty left asks whether it makes the right one."""
        if self.n_pairs >= REMEMBERED:
            for _, _, old in self.automaton.values():
                old.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        found = known[left] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def last_tokens(self, part: str) -> list[str]:
        """The last token of each prefix; the first entry is of the empty one. A character of its own, where no match is it."""
        table = ["", *part]
        for end, (token, size, known) in self.automaton.iter(part):
            left = table[end + 1 - size]
            fits = known.get(left)
            if fits or fits is None and self.compatible(left, token, known):
                table[end + 1] = token
        return table

    def encode_part(self, part: str) -> bytes:
        table, end, found, ids = self.last_tokens(part), len(part), [], self.ids
        while end:
            token = table[end]
            end -= len(token)
            number = ids.get(token)
            if number is None:
                found += [self.byte_id[b] for b in reversed(token.encode())]
            else:
                found.append(number)
        found.reverse()
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, text: str) -> bytes:
        """All ids, begin and end included, as little-endian unsigned 32-bit integers."""
        out = [np.uint32(self.begin).tobytes()]
        if text:
            known = self.parts
            for part in PARTS.findall(SPACE + text.replace(" ", SPACE)):
                ids = known.get(part)
                if ids is None:
                    ids = self.encode_part(part)
                    if len(part) < 64:
                        if len(known) >= REMEMBERED:
                            for old in list(islice(known, REMEMBERED // 2)):
                                del known[old]
                        known[part] = ids
                out.append(ids)
        out.append(np.uint32(self.end).tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Surfaces of the ids without the dummy prefix; bytes that are no UTF-8 become U+FFFD each."""
        data = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        data = data[1:] if data[:1] == b" " else data
        try:
            return data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="replace")


@lru_cache(maxsize=2)
def _loaded(digest: str, model: bytes) -> PieceTable:
    return PieceTable(model)


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, ids (little-endian unsigned 32-bit integers, begin and end included), decoded.

    Whole texts; null and empty ones have the begin and end ids alone and decode
    to an empty text. The driver reads the model, so its path need not exist on
    the executors.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    digest = hashlib.sha256(model).hexdigest()

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        table = _loaded(digest, model)
        for key, text in zip(keys, texts, strict=True):
            ids = table.encode(text or "")
            yield key, ids, table.decode(ids)

    picked = pick(docs, doc_id=id_col, text=text_col)
    return map_texts(picked, rows, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6(docs: DataFrame) -> DataFrame:
    return digests(encode_and_decode(docs, default_model()))
