"""Token ids of whole texts by a public tokenizer file, one library call per distinct chunk of text.

A text is cut at plain spaces, where the tokenizers in use always cut as well, and each distinct chunk is
encoded once per worker. The ids are those of encoding the whole text. Where a tokenizer cuts by the byte-level pattern
alone, plain texts can be cut at all of its borders instead, so that a word is encoded once whatever marks follow it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
CACHED_CHUNKS = 500_000  # per worker, twice: chunks not seen for so many new ones are encoded again
CACHED_WORDS = 100_000  # the same where words are parted from their marks
CACHED_CHARS = 48
SLICE_BYTES = 16_000_000  # of texts whose pieces are looked up together, about, or one text
WORD_SLICES = 4  # parts of that for words and marks: a slice's numbers and ids take several times its bytes
GROUP_CHUNKS = 20_000  # new chunks that the library gets at once

# A space between two other white-space characters, or between one and the end: only there does the byte-level
# pattern join white space across a cut.
_JOINED_SPACE = re.compile(r"\s (?:\s|\Z)")

_ENCODERS: dict[tuple[str, bool], "LibraryEncoder"] = {}

# Chunks that are one word and perhaps some punctuation; letters whose lower case is one letter as well.
_WORD_CHUNK = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+([.,!?;:%$#&*]+)?").fullmatch
_SOLID_CHUNK = re.compile(r"\S+").fullmatch

# The byte-level pattern cuts plain texts where the kind of character changes: letters, digits, marks (without the
# apostrophe of contractions), spaces, other white space. All other bytes have kind 0, and so have the second bytes of
# the two characters among the Latin letters that are signs.
_LETTERS, _MARKS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
_PLAIN_PIECE = re.compile(rf" ?(?:[{_LETTERS}]+|[0-9]+|[{_MARKS}]+)|[ \t\n\r]+").fullmatch
_SPACE, _WHITE = 4, 5
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[b for b in range(33, 127) if b != ord("'")]] = 3
_KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), 0xC3, *range(0x80, 0xC0)]] = 1
_KINDS[[*range(ord("0"), ord("9") + 1)]] = 2
_KINDS[[*b"\t\n\r"]] = _WHITE
_KINDS[ord(" ")] = _SPACE
_KINDS[[0x97, 0xB7]] = 0

# Between plain spaces, letters with these marks after them are two words to tokenizers that cut words from marks. Other
# bytes have kind 0.
_WORD_MARKS = ".,!?;:%$#&*"
_WORD_KINDS = np.where(_KINDS == 1, 1, 0).astype(np.uint8)
_WORD_KINDS[[*_WORD_MARKS.encode()]] = 2
_ODD_WHITE = "[\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(name if "/" in name else tokenizer_path(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes, remembering the ids of chunks.

    ``spaces_kept``: the tokenizer gives ids to white space (byte level); a chunk then takes the space before
    it along. Otherwise white space only separates words.
    """

    def __init__(self, spaces_kept: bool, special: Iterable[str]):
        self._spaces_kept = spaces_kept
        self._special = list(special)
        self._marks_apart = False  # whether letters with marks after them have the ids of both one after the other
        self._cache: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """The ids of a text without any use of chunks."""
        raise NotImplementedError

    def chunks(self, new: list[str]) -> dict[str, bytes]:
        """The ids of distinct chunks, each with the space before it if spaces are kept."""
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, chunks = b"", text.split(" ")
        if self._spaces_kept:
            if any(special in text for special in self._special) or _JOINED_SPACE.search(text):
                return self.whole(text)
            first, chunks = self.whole(chunks[0]) if chunks[0] else b"", chunks[1:]
        found = list(map(self._cache.get, chunks))
        if None in found:
            found = self._fill(chunks, found)
        return first + b"".join(found)

    def _fill(self, chunks: list[str], found: list[bytes | None]) -> list[bytes]:
        missing = {chunk for chunk, ids in zip(chunks, found) if ids is None}
        older = self._older
        fresh = {chunk: older[chunk] for chunk in missing if chunk in older}
        if len(fresh) < len(missing):
            fresh.update(self.chunks([chunk for chunk in missing if chunk not in fresh]))
        filled = [fresh[c] if ids is None else ids for c, ids in zip(chunks, found)]
        if len(self._cache) + len(fresh) > CACHED_CHUNKS:
            self._older, self._cache = self._cache, {}
        self._cache.update((c, ids) for c, ids in fresh.items() if len(c) <= CACHED_CHARS)
        return filled


    def encode_many(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: empty), where white space gets no ids.

        Texts are taken in slices: a slice's chunks are numbered, the marks after a word as one of their own. Each
        distinct one is looked up once, those not known are encoded together, and the ids of all are gathered by number.
        """
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES // WORD_SLICES, side="right")))
            ids, bounds = self._slice_in_words(texts[begin:end].cast(pa.string()))
            for a, b in zip(bounds, bounds[1:]):
                yield ids[a:b].to_pybytes() if b > a else b""
            begin = end

    def _slice_in_words(self, texts: pa.Array) -> tuple[pa.Buffer | None, list[int]]:
        """The ids of all texts in a row, and the places in them where texts begin and end."""
        starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if starts[-1] == starts[0]:
            return None, [0] * len(starts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        begins = self._words(data, starts)
        offsets = np.append(begins, len(data)).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        coded = pa.Array.from_buffers(pa.binary(), len(begins), buffers).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._known(distinct), pa.large_binary()).take(coded.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1][np.searchsorted(begins, starts)]
        return ids.buffers()[2], bounds.tolist()

    def _words(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where chunks begin in the bytes of texts that begin at ``starts``, each with the space before it, and where
        the marks after a chunk's letters begin. A chunk of any other form stays whole."""
        cut = data == ord(" ")
        cut[starts[:-1][starts[:-1] < starts[1:]]] = True
        if not self._marks_apart:
            return np.flatnonzero(cut)
        chunks, kind = np.flatnonzero(cut), _WORD_KINDS[data]
        marks = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
        other = (kind == 0) & (data != ord(" "))
        other[1:] |= (kind[1:] == 1) & (kind[:-1] == 2) & ~cut[1:]
        whole = np.zeros(len(chunks), dtype=bool)
        whole[np.searchsorted(chunks, np.flatnonzero(other), side="right") - 1] = True
        cut[marks[~whole[np.searchsorted(chunks, marks, side="right") - 1]]] = True
        return np.flatnonzero(cut)

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks, a space before them left out; the new ones are encoded in groups and remembered if
        they are short."""
        found = [self._cache.get(piece) for piece in pieces]
        missing = [piece for piece, ids in zip(pieces, found) if ids is None]
        if not missing:
            return found
        fresh = {piece: self._older[piece] for piece in missing if piece in self._older}
        new = [piece for piece in missing if piece not in fresh]
        for at in range(0, len(new), GROUP_CHUNKS):
            texts = {piece: piece.decode().removeprefix(" ") for piece in new[at : at + GROUP_CHUNKS]}
            ids = self.chunks(list(set(texts.values())))
            fresh.update((piece, ids[text]) for piece, text in texts.items())
        if len(self._cache) + len(fresh) > (CACHED_WORDS if self._marks_apart else CACHED_CHUNKS):
            self._older, self._cache = self._cache, {}
        self._cache.update((piece, ids) for piece, ids in fresh.items() if len(piece) <= CACHED_CHARS)
        return [fresh[piece] if ids is None else ids for piece, ids in zip(pieces, found)]


class LibraryEncoder(ChunkEncoder):
    """Ids by the tokenizers library."""

    def __init__(self, name: str, spaces_kept: bool):
        self._tokenizer = _load(name)
        super().__init__(spaces_kept, [t.content for t in self._tokenizer.get_added_tokens_decoder().values()])
        # Simple chunks can be told apart in the ids of many: at byte level only the first token of such a chunk
        # begins with a space, else the last token of each word has a mark.
        vocabulary = self._tokenizer.get_vocab()
        self.largest_id = max(vocabulary.values())
        self._edge = np.zeros(self.largest_id + 1, dtype=bool)
        for token, number in vocabulary.items():
            self._edge[number] = token.startswith("\u0120") if spaces_kept else token.endswith("</w>")
        self._model = self._tokenizer.model
        self._marks_apart = not spaces_kept and self._cuts_marks()
        self._pieces: dict[bytes, bytes] = {}
        self._older_pieces: dict[bytes, bytes] = {}
        self._in_pieces = spaces_kept and self._plain_byte_level()
        if self._in_pieces:
            from patronage.llm.bpe import byte_symbols

            symbol = {b: c for c, b in byte_symbols().items()}
            self._written = {c: "".join(symbol[b] for b in chr(c).encode()) for c in range(256)}

    def _cuts_marks(self) -> bool:
        """Whether the tokenizer cuts between letters and the marks after them, whatever these are."""
        cuts = self._tokenizer.pre_tokenizer
        if cuts is None or any(set(special) <= set(_WORD_MARKS) or _WORD_CHUNK(special) for special in self._special):
            return False
        ends = [mark + more for mark in _WORD_MARKS for more in ("", *_WORD_MARKS)]
        return all(cuts.pre_tokenize_str(letter + end)[0][1] == (0, 1) for letter in "aZ\u00e9" for end in ends)

    def _plain_byte_level(self) -> bool:
        """Whether texts are cut by the byte-level pattern alone and the pieces go to the library's BPE as they are."""
        from tokenizers.models import BPE

        cuts = self._tokenizer.pre_tokenizer
        state = json.loads(cuts.__getstate__()) if cuts is not None else {}
        plain = state.get("type") == "ByteLevel" and state.get("use_regex") and not state.get("add_prefix_space")
        return bool(plain) and self._tokenizer.normalizer is None and isinstance(self._model, BPE)

    def encode_pieces(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: empty) where spaces are kept.

        Texts are cut at the borders of the byte-level pattern where these are plain to see: what stands between white
        space is one piece if it has a byte of kind 0, and so is a text with special tokens or other white space. The
        pieces of a slice of texts are numbered, and each distinct one that is not remembered goes to the library once.
        """
        if not self._in_pieces:
            yield from (self.encode(text.as_py() or "") for text in texts)
            return
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
            yield from self._slice_in_pieces(texts[begin:end].cast(pa.string()))
            begin = end

    def _slice_in_pieces(self, texts: pa.Array) -> Iterator[bytes]:
        starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if starts[-1] == starts[0]:
            yield from (b"" for _ in texts)
            return
        data = np.frombuffer(texts.buffers()[2], np.uint8)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        begins = self._borders(texts, data, starts)
        offsets = np.append(begins, len(data)).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        coded = pa.Array.from_buffers(pa.binary(), len(begins), buffers).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._ids_of_pieces(distinct), pa.large_binary()).take(coded.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1][np.searchsorted(begins, starts)].tolist()
        found = ids.buffers()[2]
        for a, b in zip(bounds, bounds[1:]):
            yield found[a:b].to_pybytes() if b > a else b""

    def _borders(self, texts: pa.Array, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin in the bytes of texts that begin at ``starts``."""
        kind = _KINDS[data]
        first = starts[:-1][starts[:-1] < starts[1:]]  # of texts that are not empty
        cut = np.empty(len(data), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        white = kind >= _SPACE
        # A piece takes one space before it along. Of more white space, all but the last character is a piece, or all
        # of it at the end of a text.
        cut[1:] &= white[1:] | (kind[:-1] != _SPACE)
        inner = np.flatnonzero(white[1:] & white[:-1]) + 1
        if len(inner):
            ends = np.zeros(len(data), dtype=bool)
            ends[starts[1:][starts[1:] > 0] - 1] = True
            cut[inner] = ~ends[inner] & ~white[np.minimum(inner + 1, len(data) - 1)]
        cut[first] = True
        other = np.zeros(len(texts), dtype=bool)
        for special in self._special:
            other |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(kind == 0)
        if len(odd):
            other |= pc.match_substring_regex(texts, _ODD_WHITE).to_numpy(zero_copy_only=False)
            solid = ~white
            opens = solid.copy()
            opens[1:] &= white[:-1]
            opens[first] = solid[first]
            run = np.cumsum(opens, dtype=np.int32)
            uncut = np.zeros(run[-1] + 1, dtype=bool)
            uncut[run[odd]] = True
            cut &= ~(uncut[run] & solid & ~opens)
        for text in np.flatnonzero(other).tolist():
            cut[starts[text] + 1 : starts[text + 1]] = False
        return np.flatnonzero(cut)

    def _ids_of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        found = list(map(self._pieces.get, pieces))
        if len(self._pieces) > CACHED_CHUNKS:
            self._older_pieces, self._pieces = self._pieces, {}
        known, older, tokenize, written = self._pieces, self._older_pieces, self._model.tokenize, self._written
        for k, ids in enumerate(found):
            if ids is None:
                piece = pieces[k]
                ids = older.get(piece)
                if ids is None:
                    text = piece.decode()
                    if not _PLAIN_PIECE(text):
                        ids = self.whole(text) if len(piece) <= CACHED_CHARS else self.encode(text)
                    else:
                        symbols = text[1:] if text[0] == " " else text
                        if not symbols.isascii() or symbols[:1] in "\t\n\r ":
                            symbols = symbols.translate(written)
                        if text[0] == " ":
                            symbols = "\u0120" + symbols
                        ids = array("I", [token.id for token in tokenize(symbols)]).tobytes()
                if len(piece) <= CACHED_CHARS:
                    known[piece] = ids
                found[k] = ids
        return found

    def whole(self, text: str) -> bytes:
        return array("I", self._ids(text)).tobytes()

    def chunks(self, new: list[str]) -> dict[str, bytes]:
        prefix = " " if self._spaces_kept else ""
        match = _SOLID_CHUNK if self._spaces_kept else _WORD_CHUNK
        simple = {c: m for c in new if (m := match(c))}
        out = {c: self.whole(prefix + c) for c in new if c not in simple}
        if not simple:
            return out
        raw = self.whole(prefix + " ".join(simple))
        edges = np.flatnonzero(self._edge[np.frombuffer(raw, "<u4")]).tolist()
        if self._spaces_kept:
            bounds = [*edges, len(raw) // 4]
        else:
            words = np.cumsum([1 if m[1] is None else 2 for m in simple.values()])
            edges = [0, *(at + 1 for at in edges)]
            bounds = [0, *(edges[i] for i in words)] if words[-1] == len(edges) - 1 else []
        if len(bounds) == len(simple) + 1:
            out.update((c, raw[4 * a : 4 * b]) for c, a, b in zip(simple, bounds, bounds[1:]))
        else:
            out.update((c, self.whole(prefix + c)) for c in simple)
        return out

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def encoder(name: str, spaces_kept: bool) -> LibraryEncoder:
    """This worker's encoder for a tokenizer file, loaded once."""
    key = (name, spaces_kept)
    if key not in _ENCODERS:
        _ENCODERS[key] = LibraryEncoder(name, spaces_kept)
    return _ENCODERS[key]
