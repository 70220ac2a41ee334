"""Byte-pair encoding of SentencePiece models, on plain Python data.

`PieceModel` reads a `.model` file (through the protocol buffer that ships with
the sentencepiece package, or its pieces when that is missing) and offers

* `normalise`: longest-prefix normalisation through the compiled character map,
  with the source byte of every normalised byte recorded;
* `encode`: ids of a text and the bytes of it that each covers, by `normalise` and
  heap-and-linked-list merging, by score, leftmost first;
* `count`: the same merging, counting only (initial symbols minus merges).

A text is cut into chunks where no piece of the vocabulary can reach across:
before each run of the space mark that follows another symbol, and around
characters that occur in no multi-character piece. Merges inside one chunk never
depend on another chunk, so chunk results can be kept in a bounded cache.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable
from operator import add

import numpy as np

SPACE = "▁"
#: Fixed values of the model format: piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries of each of the two generations of a worker's cache: bounds the memory.
CACHE = 400_000
_ID = struct.Struct("<II")


class Cache(dict):
    """Results of `work` by chunk. When it is full it becomes the old generation, which
    is dropped at the next turn, so that chunks in use stay. Long chunks are not kept."""

    def __init__(self, work: Callable) -> None:
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, chunk: str):
        got = self.old.get(chunk)
        if got is None:
            got = self.work(chunk)
        if len(chunk) <= 64:
            self[chunk] = got
        return got

    def turn(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class CharacterMap:
    """The compiled character map: a double-array trie and a pool of replacements.

    The blob is: little-endian uint32 size of the trie, the trie's uint32 units,
    then zero-terminated replacement strings; a trie value is an offset in them.
    """

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.pool = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.pool = blob[4 + n :]

    def firsts(self) -> bytes:
        """The bytes that keys begin with."""
        if not self.units:
            return b""
        at = self._offset(self.units[0])
        return bytes(b for b in range(1, 256) if (at ^ b) < len(self.units) and self.units[at ^ b] & 0x800000FF == b)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that starts at `at`."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = self._offset(unit)
        for i in range(at, len(text)):
            byte = text[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class PieceModel:
    """A BPE model of the sentencepiece library. Models of other types, those with
    user-defined or unused pieces, and white space as a suffix raise ValueError."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("only BPE models are supported")
        kinds = {p.type for p in proto.pieces}
        if kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("user-defined and unused pieces are not supported")
        spec = proto.normalizer_spec
        self.dummy_prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.mark = SPACE if spec.escape_whitespaces else " "
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("white space as a suffix is not supported")
        self.map_by(spec.precompiled_charsmap)
        names = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        joined = {c for p in names if len(p) > 1 for c in p}
        #: Of each piece, its id and its bytes in UTF-8, packed.
        self.taken = {p: _ID.pack(i, len(p.encode("utf-8"))) for p, i in names.items()}
        # Equal scores are equal ranks, so the leftmost of them goes first.
        order = {s: r for r, s in enumerate(sorted({-p.score for p in proto.pieces if p.type == NORMAL}))}
        self.rank = {p.piece: order[-p.score] for p in proto.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bos = next((i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.bos_piece), -1)
        self.eos = next((i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece), -1)
        inner = any(SPACE in p.lstrip(SPACE) for p in names)
        apart = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        if inner:
            self.chunk = re.compile(r"[\s\S]+")
        elif apart:
            self.chunk = re.compile(f"[{apart}]|{SPACE}*[^{SPACE}{apart}]+|{SPACE}+")
        else:
            self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.parts = None if inner else self._apart(names)
        self._encoded, self._counts = Cache(self._encode), Cache(self._count)

    @staticmethod
    def _apart(names: dict[str, int]) -> re.Pattern | None:
        """What takes a chunk apart where no piece reaches across: characters that pieces
        join, directly or through others, are of one kind, and so are all those that none
        joins. None if there is but one kind."""
        kind: dict[str, str] = {}

        def find(c: str) -> str:
            while (up := kind.setdefault(c, c)) != c:
                kind[c] = c = kind[up]
            return c

        for p in names:
            word = p.lstrip(SPACE)
            for a, b in zip(word, word[1:]):
                kind[find(a)] = find(b)
        kinds: dict[str, list[str]] = {}
        for c in kind:
            kinds.setdefault(find(c), []).append(c)
        if not kinds:
            return None
        sets = ["".join(map(re.escape, sorted(k))) for k in sorted(kinds.values(), key=len, reverse=True)]
        return re.compile(f"{SPACE}*(?:" + "|".join(f"[{k}]+" for k in sets) + f"|[^{SPACE}{''.join(sets)}]+)|{SPACE}+")

    # -- normalisation -------------------------------------------------------

    def map_by(self, blob: bytes) -> None:
        """Sets the character map, and what finds the places where it may apply."""
        self.charmap = CharacterMap(blob)
        firsts = self.charmap.firsts() + (b" " if self.squeeze else b"")
        self.special = re.compile(b"[" + re.escape(firsts) + b"]") if firsts else None

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its UTF-8 bytes and its end, the source byte.

        At each place the longest prefix in the character map is replaced; without
        one, a character stands for itself. The space mark replaces spaces. Stretches
        in which the map has no key are taken as they are.
        """
        source = text.encode("utf-8")
        if not source:
            return "", np.zeros(1, dtype=np.int32)
        mark, wide = self.mark.encode("utf-8"), len(self.mark.encode("utf-8"))
        out: list[bytes] = [mark] if self.dummy_prefix else []
        #: For each part of the output, the source byte of each of its bytes, as arrays.
        align: list[np.ndarray] = [np.zeros(wide, dtype=np.int32)] if self.dummy_prefix else []
        at, n, gap = 0, len(source), self.squeeze

        def plain(stop: int) -> None:
            if stop > at:
                part = source[at:stop]
                places = np.arange(at, stop, dtype=np.int32)
                if wide > 1 and b" " in part:
                    places = np.repeat(places, np.where(np.frombuffer(part, np.uint8) == 32, wide, 1))
                out.append(part.replace(b" ", mark))
                align.append(places)

        while self.special and (m := self.special.search(source, at)):
            here = m.start()
            hit = self.charmap.longest(source, here)
            if not hit and source[here] != 32:  # no key starts at this character after all
                size = 1 if source[here] < 0x80 else 2 if source[here] < 0xE0 else 3 if source[here] < 0xF0 else 4
                hit = size, source[here : here + size]
            size, piece = hit or (1, b" ")
            if here > at:
                gap = False
            plain(here)
            if self.squeeze and gap:
                piece = piece.lstrip(b" ")
            if self.squeeze and piece:
                gap = piece.endswith(b" ")
            piece = piece.replace(b" ", mark)
            out.append(piece)
            align.append(np.full(len(piece), here, dtype=np.int32))
            at = here + size
        plain(n)
        whole = b"".join(out)
        if self.squeeze:
            size = len(whole)
            while size > wide and whole.endswith(mark, 0, size):
                size -= wide
            whole = whole[:size]
        return whole.decode("utf-8"), np.append(np.concatenate(align or [np.zeros(0, np.int32)])[: len(whole)], np.int32(n))

    # -- merging -------------------------------------------------------------

    def merge(self, chunk: str) -> tuple[list[int], int]:
        """Where each symbol of a chunk ends after all merges (0 where none starts any
        more), and the number of merges.

        Symbols are a linked list: the next one starts where one ends. A heap holds the
        adjacent pairs that join to a piece, by (rank, place). `due` has the entry that
        holds at each place, so a popped one that is another's, or none's any more, is
        passed over without a look at its pair.
        """
        n, get = len(chunk), self.rank.get
        after = list(range(1, n + 1))
        # An entry is rank * n + place, which orders as the pair does and compares faster.
        due = [-1 if r is None else r * n + i for i, r in enumerate(map(get, map(add, chunk, chunk[1:])))]
        heap = [e for e in due if e >= 0]
        if not heap:
            return after, 0
        before = list(range(-1, n - 1))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        merges = 0
        while heap:
            entry = pop(heap)
            i = entry % n
            if due[i] != entry:
                continue
            j = after[i]
            k = after[j]
            merges += 1
            after[i], after[j] = k, 0
            due[i] = -1
            if k < n:
                before[k] = i
                due[j] = -1
                if (r := get(chunk[i : after[k]])) is not None:
                    due[i] = r = r * n + i
                    push(heap, r)
            if (h := before[i]) >= 0:
                if (r := get(chunk[h:k])) is None:
                    due[h] = -1
                else:
                    due[h] = r = r * n + h
                    push(heap, r)
        return after, merges

    def _encode(self, chunk: str) -> bytes:
        """Of each id of one chunk, itself and the normalised bytes it takes. A symbol
        outside the vocabulary gives its bytes, the last of which takes them all."""
        if self.parts and len(parts := self.parts.findall(chunk)) > 1:
            return b"".join(map(self._encoded.__getitem__, parts))
        after, _ = self.merge(chunk)
        out, at, n, taken = [], 0, len(chunk), self.taken
        while at < n:
            to = after[at]
            out.append(taken.get(chunk[at:to]) or self._outside(chunk[at:to]))
            at = to
        return b"".join(out)

    def _outside(self, symbol: str) -> bytes:
        raw = symbol.encode("utf-8")
        more = [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]
        return b"".join(_ID.pack(b, 0) for b in more[:-1]) + _ID.pack(more[-1], len(raw))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text, and the begin and the end of each in bytes of the original
        text.

        Pieces are projected through the alignment of `normalise`. Byte pieces of one
        character share its span as the library has it: all but the last are empty.
        """
        self._encoded.turn()
        normal, align = self.normalise(text)
        both = np.frombuffer(b"".join(map(self._encoded.__getitem__, self.chunk.findall(normal))), dtype="<u4").reshape(-1, 2)
        edges = np.zeros(len(both) + 1, dtype=np.int64)
        np.cumsum(both[:, 1], out=edges[1:])
        places = align[edges]
        return both[:, 0], places[:-1], places[1:]

    def _count(self, chunk: str) -> int:
        """Tokens of one chunk: its initial symbols (bytes for a character outside the
        vocabulary) minus its merges, counted as they are popped; no identifier is
        looked up."""
        if self.parts and len(parts := self.parts.findall(chunk)) > 1:
            return sum(map(self._counts.__getitem__, parts))
        merges = self.merge(chunk)[1]
        if not self.byte_ids:
            return len(chunk) - merges
        return sum(1 if c in self.rank else len(c.encode("utf-8")) for c in chunk) - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text, without begin and end."""
        self._counts.turn()
        return sum(map(self._counts.__getitem__, self.chunk.findall(self.normalise(text)[0])))
