"""Token ids of texts by a word-level byte-pair tokenizer of the ``tokenizers`` library.

The tokenizer's rules never look across white space, so a text's ids are those of its pieces
between spaces and line feeds, in order. Distinct pieces are found per slice in C++. Most are Latin
letters and then ASCII punctuation, whose ids are those of the letters, in lower case, and of the
punctuation: C++ splits them, and only distinct parts are encoded. A two-generation cache of bounded
size keeps frequent parts.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfspark.llm.common import gather, kept, words_of

#: Parts of pieces a worker keeps per generation of its cache.
CACHE_PIECES = 1 << 16

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII punctuation but the apostrophe.
_PUNCTUATION = "!-&(-/:-@\\[-`{-~"
#: Letters that normalisation only lower-cases, then punctuation.
_PLAIN = f"^[{_LATIN}]+[{_PUNCTUATION}]*$"
_MARKS = "".join(c for c in map(chr, range(33, 127)) if re.match(f"[{_PUNCTUATION}]", c))
_LETTERS = "".join(c for c in map(chr, range(256)) if re.match(f"[{_LATIN}]", c))


def _byte_alphabet() -> dict[int, str]:
    """Printable characters that stand for bytes in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        alphabet = _byte_alphabet()
        self.lowered = str.maketrans({c: "".join(alphabet[b] for b in c.lower().encode()) for c in _LETTERS})
        self.new, self.old = {}, {}

    def _part(self, part: str) -> bytes:
        """Little-endian ids of letters or of punctuation, from the model alone."""
        got = self.old.get(part)
        if got is None:
            got = array("I", [t.id for t in self.model.tokenize(part.translate(self.lowered))]).tobytes()
        if len(self.new) >= CACHE_PIECES:
            self.old, self.new = self.new, {}
        self.new[part] = got
        return got

    def _other(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _table(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all items, their numbers of ids)."""
        return np.frombuffer(b"".join(items), "<u4"), np.fromiter(map(len, items), np.int64, len(items)) // 4

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces, none with white space, one after another, how many each has)."""
        plain = pc.match_substring_regex(pieces, _PLAIN)
        usual = pieces.filter(plain)
        letters = pc.ascii_lower(pc.utf8_rtrim(usual, characters=_MARKS)).dictionary_encode()
        marks = pc.utf8_ltrim(usual, characters=_LETTERS).dictionary_encode()
        known = self.new.get
        first = [known(p) or self._part(p) for p in letters.dictionary.to_pylist()]
        second = [known(p) or self._part(p) if p else b"" for p in marks.dictionary.to_pylist()]
        rest = [self._other(p) if p else b"" for p in pieces.filter(pc.invert(plain)).to_pylist()]
        ids, sizes = self._table(first + second + rest)
        is_plain = plain.to_numpy(zero_copy_only=False)
        # two entries for a plain piece, one for another
        count = 1 + is_plain.astype(np.int64)
        at = np.cumsum(count) - count
        entry = np.empty(count.sum(), np.int64)
        entry[at[is_plain]] = letters.indices.to_numpy()
        entry[at[is_plain] + 1] = len(first) + marks.indices.to_numpy()
        entry[at[~is_plain]] = len(first) + len(second) + np.arange(len(rest))
        starts = np.cumsum(sizes) - sizes
        before = np.concatenate([[0], np.cumsum(sizes[entry])])
        return gather(ids, starts[entry], sizes[entry]), before[at + count] - before[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them)."""
        codes, offsets, pieces = words_of(pc.replace_substring(texts, "\n", " "))
        ids, lengths = self.pieces(pieces)
        starts = np.cumsum(lengths) - lengths
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        return gather(ids, starts[codes], lengths[codes]), ends[offsets]


def encoder(tokenizer_json: str) -> Encoder:
    """The worker's encoder for a tokenizer."""
    return kept(("word_bpe", zlib.crc32(tokenizer_json.encode())), lambda: Encoder(tokenizer_json))
