"""Distinct-chunk tables: a text is cut where no token can cross, each distinct chunk is encoded once, and ids are joined by position.

A worker keeps its table between batches, up to a bounded number of entries. Long chunks are encoded but not kept. A column of texts is cut by
its bytes, without a string for each chunk, and its distinct chunks alone are looked up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa

#: Entries of a worker's table; beyond them it keeps those of the texts at hand.
TABLE_ENTRIES = 700_000
#: Longer chunks are rare and don't repeat.
KEEP_CHARS = 48

#: Texts cut at once, in characters.
BATCH_CHARS = 2 << 20
#: Texts of a column cut at once, in bytes.
BATCH_BYTES = 8 << 20
#: White space as the GPT-2 pattern has it: Unicode's, which lacks four control characters that Python's has.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The GPT-2 pattern with all that is not white space taken together: no token of its byte-level BPE crosses these chunks.
BYTE_BPE_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same where all characters are ASCII.
ASCII_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+", re.ASCII)
#: White space of more than one byte, in UTF-8.
WIDE_SPACES = [c.encode() for c in map(chr, range(0x80, 0x3001)) if re.match(f"[{SPACE}]", c)]
#: By byte: ASCII letters and digits; what else ASCII has that is visible.
WORD_BYTE = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
SIGN_BYTE = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
#: First bytes of two-byte characters that are all letters, but for the multiplication and division signs: Latin from U+00C0, Cyrillic to U+047F.
LETTER_LEAD = np.array([0xC3 <= b <= 0xC8 or b in (0xD0, 0xD1) for b in range(256)])
#: A run of markers and what follows up to the next marker.
MARKED_WORD = re.compile(r" *[^ ]+| +")
MARKER = "▁"
#: Chunks encoded as one text.
JOINED = 100


class ChunkTable:
    """cut: text to chunks. encode: list of chunks to the little-endian 32-bit ids of each."""

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], Iterable[bytes]]):
        self.cut, self.encode, self.table, self.last = cut, encode, {}, []

    def __call__(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                out += self.together(held)
                held, size = [], 0
        return out + self.together(held)

    def rest(self, entries: int = 0) -> None:
        """Between tasks a worker keeps a table of up to so many entries; of a larger one, the chunks of the last texts, the frequent ones among
        them, and gives the other memory back."""
        if len(self.table) > entries:
            self.table = {c: self.table[c] for c in set(self.last).intersection(self.table)}
        self.last = []

    def together(self, texts: list[str]) -> list[bytes]:
        self.last = []
        cut = [self.cut(x) for x in texts]
        ids = self.ids(list(chain.from_iterable(cut)))
        out, at = [], 0
        for x in cut:
            out.append(b"".join(ids[at : at + len(x)]))
            at += len(x)
        return out

    def ids(self, chunks: list[str]) -> list[bytes]:
        if len(self.table) > TABLE_ENTRIES:
            self.table = {c: self.table[c] for c in set(chunks).intersection(self.table)}
        # each chunk is looked up once; those that the table lacks are filled in
        ids = list(map(self.table.get, chunks))
        gaps = [i for i, x in enumerate(ids) if x is None]
        new = list({chunks[i] for i in gaps})
        self.table.update(zip(new, self.encode(new), strict=True))
        for i in gaps:
            ids[i] = self.table[chunks[i]]
        for c in new:
            if len(c) > KEEP_CHARS:
                del self.table[c]
        self.last = chunks
        return ids


class ByteChunkTable(ChunkTable):
    """A table of byte-level chunks, for columns also. added: strings that the library takes out of a text before anything else."""

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], Iterable[bytes]], added: list[str]):
        super().__init__(cut, encode)
        self.added = added

    def column(self, texts: pa.Array) -> list[bytes]:
        """As of a list of the texts of a string column; null counts as empty. Those with an added string are cut one by one."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        added = np.zeros(len(texts), bool)
        for x in self.added:
            added |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(added)
        found = self(texts.take(pa.array(apart)).to_pylist())
        if len(apart):
            texts = pc.if_else(pa.array(added), "", texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out: list[bytes] = []
        while len(out) < len(texts):
            first = len(out)
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BATCH_BYTES, "right")) - 1)
            out += self.slice(data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
        for i, x in zip(apart.tolist(), found, strict=True):
            out[i] = x
        return out

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        at = byte_cuts(data, offsets)
        if not len(at):
            return [b""] * (len(offsets) - 1)
        bounds = pa.py_buffer(np.append(at, len(data)))
        coded = pa.Array.from_buffers(pa.large_string(), len(at), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        ids = self.ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        joined = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(at) + 1)[np.searchsorted(at, offsets)].tolist()
        joined = memoryview(joined.buffers()[2] or b"")
        return [bytes(joined[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def byte_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin, of texts one after another in UTF-8: as BYTE_BPE_CHUNK cuts, and before a sign that ends a word.

    White space begins a chunk unless there is some before it and some, or the end, behind it; other characters do after white space that is no
    space. A sign between a letter or digit and white space or the end is a token's begin; where letters aren't known to be some, it stays in its word.
    """
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    if not len(begins):
        return begins
    space = (data == 32) | (data - np.uint8(9) < 5)
    first, wide = space.copy(), []  # first bytes of white space
    for lead in {form[0] for form in WIDE_SPACES}:
        found = np.flatnonzero(data == lead)
        for form in (x for x in WIDE_SPACES if x[0] == lead) if len(found) else ():
            hit = found[found + len(form) <= len(data)]
            for k in range(1, len(form)):
                hit = hit[data[hit + k] == form[k]]
            for k in range(len(form)):
                space[hit + k] = True
            first[hit] = True
            wide.append((hit, len(form)))
    closed = np.append(space[1:], True)  # white space or the end is behind
    closed[begins[1:] - 1] = True
    sign = np.flatnonzero(closed & ~space)
    sign = sign[SIGN_BYTE[data[sign]] & (sign > 1)]
    before, lead = data[sign - 1], data[sign - 2]
    letter = LETTER_LEAD[lead] & (before >= 128) & (before < 192) & ((lead != 0xC3) | (before != 0x97) & (before != 0xB7))
    for hit, size in wide:
        closed[hit] = closed[hit + size - 1]
    cut = np.zeros(len(data), bool)
    cut[1:] = (first[1:] & ~(space[:-1] & closed[1:])) | (space[:-1] & ~space[1:] & (data[:-1] != 32))
    cut[sign[WORD_BYTE[before] | letter]] = True
    cut[begins] = True
    return np.flatnonzero(cut)


def joined_ids(model, chunks: list[str]) -> list[bytes]:
    """The ids of byte-level chunks, many encoded as one text: a line feed between two words is a token of its own and in no word."""
    feed = model.encode("\n", add_special_tokens=False).ids
    words = [i for i, c in enumerate(chunks) if not c.isspace()]
    rest = sorted(set(range(len(chunks))).difference(words))
    out: list[bytes] = [b""] * len(chunks)
    for i, e in zip(rest, model.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = np.asarray(e.ids, "<u4").tobytes()
    groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
    for group, e in zip(groups, model.encode_batch_fast(["\n".join([chunks[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
        ids = np.asarray(e.ids, "<u4")
        ends = np.append(np.flatnonzero(ids == feed[0]), len(ids)).tolist()
        data, at = ids.tobytes(), 0
        if len(ends) != len(group):
            raise ValueError("a chunk holds the separator")
        for i, end in zip(group, ends, strict=True):
            out[i] = data[4 * at : 4 * end]
            at = end + 1
    return out


_tables: dict[tuple[str, str], ChunkTable | ByteChunkTable] = {}
_models: dict[str, object] = {}


def byte_bpe(path: str) -> ByteChunkTable:
    """Of a byte-level BPE file of the tokenizers library, for this worker."""
    if ("byte", path) not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        # the library takes these strings out of a text before anything else
        strings = [t.content for t in model.get_added_tokens_decoder().values()]
        added = re.compile("(" + "|".join(map(re.escape, strings)) + ")")

        def cut(text: str) -> list[str]:
            chunk = ASCII_CHUNK if text.isascii() else BYTE_BPE_CHUNK
            if not added.search(text):
                return chunk.findall(text)
            return [c for i, part in enumerate(added.split(text)) for c in ([part] if i % 2 else chunk.findall(part))]

        _tables["byte", path] = ByteChunkTable(cut, lambda chunks: joined_ids(model, chunks), strings)
    return _tables["byte", path]


def piece_model(path: str):
    """The sentencepiece processor of this worker."""
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


#: What a model may change before it cuts: compatibility forms, several spaces, spaces at the ends, controls, tabs and line feeds.
PROBES = ["", " ", "a", "a b", "  a   b  ", "a\tb\nc", "\ufb01 \u2460 \uff21\u3000x", "e\u0301 \u00e9", "\u2581a \u2581\u2581", "A\u00a0b\u00adc", "\x00\x1f", "\u0130 \u00df"]


def crosses_marker(path: str) -> bool:
    """Whether words can't be cut apart: a piece of the model has a marker after another character, or the model changes texts before it cuts
    them or puts no marker before them, as PROBES show."""
    model = piece_model(path)
    if any(MARKER in model.id_to_piece(i).lstrip(MARKER) for i in range(model.get_piece_size())):
        return True
    return pieces(path)(PROBES) != [np.asarray(x, "<u4").tobytes() for x in model.encode(PROBES, num_threads=1)]


def pieces(path: str) -> ChunkTable:
    """Of a sentencepiece model whose pieces don't cross markers: chunks begin with the marker, written as a space, that the model itself puts before a text."""
    if ("piece", path) not in _tables:
        model = piece_model(path)
        cut = lambda text: MARKED_WORD.findall(" " + text.replace(MARKER, " ")) if text else []
        marker = [model.piece_to_id(MARKER)]  # of a last lone space: the model puts no marker before an empty text
        encode = lambda chunks: [np.asarray(marker if c == " " else x, "<u4").tobytes() for c, x in zip(chunks, model.encode([c[1:] for c in chunks], num_threads=1), strict=True)]
        _tables["piece", path] = ChunkTable(cut, encode)
    return _tables["piece", path]
