"""Operator 7: SentencePiece encoding and decoding by a prefix table.

For merge-type (BPE) vocabularies every prefix of a text has one encoding, so
one last token. The table holds that token for each prefix: an automaton lists
the pieces that end at a position, and the one that fits is the piece whose
pair with the last token of the prefix before it survives merging, that is,
encodes to exactly these two. The ids are then read backwards from the end.
Pair tests are remembered.

A text is cut where no piece can reach across: before the word mark, and around
characters outside the vocabulary, which become byte ids. Frequent cuts are
remembered by a Python worker across its tasks, up to a bound, so memory is bounded and time is linear in the text.

Defined results: null text is the empty text; the empty text has the end id
only and decodes to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from plansift.llm.tokens import kept_in_worker

MARK = "▁"
#: Remembered cuts; over it the memory starts anew. Longer cuts are not remembered.
MEMORY = 1 << 19
MEMORY_CHARS = 64


def public_model(name: str = "piece_bpe_32k.model") -> bytes:
    """A model of the installed public tokenizer files."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


class PieceTable(dict):
    """Encoder and decoder of one model; as a dict it maps a cut to its ids."""

    def __init__(self, model: bytes):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = processor.eos_id()
        size = processor.get_piece_size()
        pieces = [processor.id_to_piece(i) for i in range(size)]
        self.surface = [b""] * size
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, piece in enumerate(pieces):
            if processor.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.surface[i] = bytes([value])
            elif not (processor.is_control(i) or processor.is_unknown(i)):
                self.ids[piece] = i
                self.score[piece] = processor.get_score(i)
                self.surface[i] = piece.replace(MARK, " ").encode()
        self.pieces = pieces
        self.alphabet = {p for p in self.ids if len(p) == 1}
        self.text = [str(i) for i in range(size)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: best score first, leftmost on ties."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, piece: int) -> bool:
        """Whether the two pieces side by side stay these two."""
        known = self.pairs.get((before, piece))
        if known is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            x, y = self.pieces[before], self.pieces[piece]
            known = self.pairs[before, piece] = self.merged(x + y) == [x, y]
        return known

    def stands(self, piece: int) -> bool:
        """Whether merging the piece's own text gives the piece."""
        known = self.alone.get(piece)
        if known is None:
            known = self.alone[piece] = len(self.merged(self.pieces[piece])) == 1
        return known

    def span(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        last = [-1] * (len(text) + 1)
        for at, (piece, size) in self.automaton.iter(text):
            end = at + 1
            if last[end] < 0:
                before = last[end - size] if end > size else None
                if self.stands(piece) if before is None else before >= 0 and self.fits(before, piece):
                    last[end] = piece
        ids, end = [], len(text)
        while end:
            ids.append(last[end])
            end -= len(self.pieces[last[end]])
        return ids[::-1]

    def ids_of(self, text: str) -> tuple[int, ...]:
        alphabet, ids, start = self.alphabet, [], 0
        for at, char in enumerate(text):
            if char not in alphabet:
                if start < at:
                    ids += self.span(text[start:at])
                ids += [self.byte_ids[b] for b in char.encode()]
                start = at + 1
        if start < len(text):
            ids += self.span(text[start:])
        return tuple(ids)

    def __missing__(self, cut: str) -> tuple[int, ...]:
        ids = self.ids_of(cut)
        if len(cut) <= MEMORY_CHARS:
            if len(self) >= MEMORY:
                self.clear()
            self[cut] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text and the end id."""
        if not text:
            return [self.end]
        ids = list(chain.from_iterable(map(self.__getitem__, self.cut.findall(MARK + text.replace(" ", MARK)))))
        ids.append(self.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the word mark that encoding put in front goes."""
        data = b"".join(map(self.surface.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, model: bytes, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and decoded per document; with ``digest`` ids and decoded are sha256 digests.

    The digest of ids is over their decimal forms joined by a space. ``model`` is
    the serialised model, about half a megabyte, sent with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or kept_in_worker(("pieces", hashlib.sha256(shared.value).digest()), lambda: PieceTable(shared.value))
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sizes, ids, decoded = [], [], []
                for text in part.column("text").to_pylist():
                    got = table.encode(text or "")
                    back = table.decode(got)
                    sizes.append(len(got))
                    ids.append(sha(" ".join(map(table.text.__getitem__, got))) if digest else got)
                    decoded.append(sha(back) if digest else back)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(decoded, pa.string()),
                ], ["doc_id", "n_tokens", "ids", "decoded"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_tokens long, ids {'string' if digest else 'array<int>'}, decoded string")
