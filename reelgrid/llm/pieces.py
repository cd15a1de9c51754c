"""SentencePiece encoding that keeps the byte span of every piece, and decoding.

A model file gives the vocabulary with scores and the compiled character map (a double-array trie over byte strings, with the texts
that replace them). Normalising takes the longest prefix the map knows at each place, else one code point, then escapes blanks; for every
normalised code point it notes where in the source the bytes behind it begin. Merging joins the neighbours with the best score,
leftmost first. What is left outside the vocabulary falls back to bytes. A piece's span runs from the place of its
first code point to the place after its last one, so spans cover the source in order.

Where no piece of the vocabulary goes on with a blank mark after another character, merges cannot cross such a place: a text is then
merged word by word, and words seen before are taken from a store that holds a bounded number of short words. Each text is one row of
one task, nothing is shuffled.

Nulls: a null text is the empty one, whose only id is the end; a null id is passed through. Repeated rows give equal results each. Equal
scores go leftmost first. Long texts are taken whole, words without blanks of any length included. An empty table gives no rows.
Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2 as model_format

from reelgrid.llm.texts import columns

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bound of the words that are kept in memory with their pieces, for each Python worker, and the length up to which a word is kept.
STORED_WORDS, STORED_CHARS = 300_000, 40


class CharMap:
    """Longest-prefix replacement through the compiled character map: the trie's units, then the replacing texts, each ended by a null."""

    def __init__(self, compiled: bytes) -> None:
        n = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4:4 + n], "<u4").tolist()
        self.texts = compiled[4 + n:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest known prefix at a place."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]

    def first_bytes(self) -> bytes:
        """Bytes at which a known prefix may begin."""
        if not self.units:
            return b""
        node = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6)
        return bytes(b for b in range(256) if (node ^ b) < len(self.units) and self.units[node ^ b] & 0x800000FF == b)


class PieceModel:
    """A model file of the merging kind, with its normaliser."""

    def __init__(self, data: bytes) -> None:
        proto = model_format.ModelProto()
        proto.ParseFromString(data)
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("only models that merge pairs are supported")
        kinds = [p.type for p in proto.pieces]
        if USER_DEFINED in kinds or UNUSED in kinds or proto.denormalizer_spec.precompiled_charsmap or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("user-defined and unused pieces, blanks as endings and rules for decoding are not supported")
        names = [p.piece for p in proto.pieces]
        spec = proto.normalizer_spec
        self.add_blank, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.map = CharMap(spec.precompiled_charsmap)
        first = self.map.first_bytes()
        self._touched = re.compile(b"[" + re.escape(first) + b"]") if first else None
        self.ids = {p: i for i, p in enumerate(names) if kinds[i] == NORMAL}
        self.rank = {p: -proto.pieces[i].score for p, i in self.ids.items()}
        self.byte_ids = [next((i for i, p in enumerate(names) if kinds[i] == BYTE and p == f"<0x{b:02X}>"), None) for b in range(256)]
        self.fallback = proto.trainer_spec.byte_fallback
        self.unknown = kinds.index(UNKNOWN)
        self.end = names.index(proto.trainer_spec.eos_piece or "</s>")
        self.kinds = kinds
        self._control = np.array([k == CONTROL for k in kinds])
        surface = {CONTROL: lambda p: "", UNKNOWN: lambda p: proto.trainer_spec.unk_surface}
        self.surfaces = [bytes([int(p[3:5], 16)]) if k == BYTE else surface.get(k, lambda p: p.replace(MARK, " "))(p).encode() for p, k in zip(names, kinds)]
        self.decimals = [str(i) for i in range(len(names))]
        inner = re.compile(f"[^{MARK}]{MARK}")
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in joined)      # never merged with anything
        self._words = None
        if not any(inner.search(p) for p in self.ids):
            self._words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self._store: dict[str, tuple[bytes, bytes]] = {}

    def _replaced(self, data: bytes) -> tuple[str, np.ndarray]:
        """The text after the character map, and the source byte behind each of its code points; one more entry for the end."""
        if self._touched is None:
            return data.decode(), _starts(data)
        parts, places, at, k = [], [], 0, 0
        while True:
            hit = self._touched.search(data, k)
            rule = self.map.longest(data, hit.start()) if hit else None
            if hit and rule is None:
                k = hit.end()
                while k < len(data) and data[k] & 0xC0 == 0x80:       # on to the next code point
                    k += 1
                continue
            stop = hit.start() if hit else len(data)
            if stop > at:
                parts.append(data[at:stop].decode())
                places.append(_starts(data[at:stop])[:-1] + at)
            if not hit:
                return "".join(parts), np.concatenate([*places, [len(data)]]).astype(np.int64)
            new = rule[1].decode()
            parts.append(new)
            places.append(np.full(len(new), stop))
            at = k = stop + rule[0]

    def normalise(self, data: bytes) -> tuple[str, np.ndarray]:
        """Normalised text, and for each code point of it (and its end) the byte of the source where it begins."""
        text, at = self._replaced(data)
        if self.squeeze:                                             # no blanks at the ends, one between words
            blank = np.array([c == " " for c in text], bool)
            keep = ~blank
            if keep.any():
                keep[1:] |= blank[1:] & ~blank[:-1]
                last = len(text) - 1 - int(np.argmax(~blank[::-1]))
                keep[:int(np.argmax(~blank))] = False
                keep[last + 1:] = False
                at = np.append(at[:-1][keep], at[last + 1])
                text = "".join(c for c, k in zip(text, keep.tolist()) if k)
            else:
                text, at = "", at[:1]
        if not text:
            return "", at[:1]
        if self.add_blank:
            text, at = " " + text, np.concatenate([at[:1], at])
        return (text.replace(" ", MARK) if self.escape else text), at

    def _merge(self, word: str) -> list[str]:
        """Joins the pair of the best score, leftmost first, until no pair is a piece."""
        rank, parts = self.rank.get, list(word)
        if len(parts) > 200:
            return self._merge_long(parts)
        none = float("inf")
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of pairs, whose outdated entries are skipped."""
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := rank(parts[i] + parts[j])) is not None:
                heappush(heap, (r, i, parts[i], parts[j], j))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, j = heappop(heap)
            if parts[i] != a or after[i] != j or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def _coded(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a word and the code points that end with each of them, both as int32; of several bytes of one symbol the last ends it."""
        held = self._store.get(word)
        if held is not None:
            return held
        ids, sizes = [], []
        for part in self._merge(word):
            known = self.ids.get(part)
            if known is None and self.fallback:
                made = [self.byte_ids[b] for b in part.encode()]
                ids += made
                sizes += [0] * (len(made) - 1) + [len(part)]
            elif known is None and ids and ids[-1] == self.unknown:
                sizes[-1] += len(part)                               # unknown neighbours are one piece
            else:
                ids.append(self.unknown if known is None else known)
                sizes.append(len(part))
        made = array("i", ids).tobytes(), array("i", sizes).tobytes()
        if len(word) <= STORED_CHARS and self._words is not None:
            if len(self._store) >= STORED_WORDS:
                self._store.clear()
            self._store[word] = made
        return made

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): spans are bytes of the source. Of a symbol that falls back to several bytes, all but the last have empty spans."""
        text, at = self.normalise(data)
        coded = [self._coded(w) for w in (self._words.findall(text) if self._words else [text] if text else [])]
        ids = np.frombuffer(b"".join([c[0] for c in coded]), np.int32)
        ends = np.cumsum(np.frombuffer(b"".join([c[1] for c in coded]), np.int32), dtype=np.int64)
        if not self.fallback and len(ids):                           # unknown neighbours of two words are one piece, too
            last = np.append((ids[1:] != self.unknown) | (ids[:-1] != self.unknown), True)
            ids, ends = ids[last], ends[last]
        stops = at[ends]
        return ids, np.concatenate([at[:1], stops[:-1]])[:len(ids)], stops

    def decode(self, ids: list[int]) -> bytes:
        """The text of some ids, control ids left out. Neighbouring byte ids that are no UTF-8 become U+FFFD each."""
        kinds, surfaces = self.kinds, self.surfaces
        data = b"".join([surfaces[i] for i in ids])
        if self._control[ids[:-1]].any() or not _is_text(data):      # a control id parts the bytes beside it
            data = b"".join(_mended(b"".join([surfaces[i] for i in part])) if raw else b"".join([surfaces[i] for i in part])
                            for raw, part in groupby(ids, lambda i: kinds[i] == BYTE))
        first = next((i for i in ids if kinds[i] != CONTROL), None)
        if first is not None and kinds[first] == NORMAL and (self.add_blank or self.squeeze):
            data = data.lstrip(b" ") if self.squeeze else data.removeprefix(b" ")
        return data


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _mended(data: bytes) -> bytes:
    return re.sub("[\udc80-\udcff]", "\ufffd", data.decode(errors="surrogateescape")).encode()


def _starts(data: bytes) -> np.ndarray:
    """Where each code point begins, and the end."""
    raw = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def encode_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_pieces: bool = False) -> DataFrame:
    """One row a document: doc_id, n_tokens (the end id counted), ids_sha256 of the decimal ids joined by blanks, decoded_sha256 of the text
    that the ids decode to, spans_sha256 of the ends of all pieces (bytes of the source, int64), and on demand pieces: id, begin, end of each."""
    key = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType.simpleString()
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("id", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            rows = []
            for body in next(columns(batch, "text")):
                found, begins, ends = model.encode(body or b"")
                ids = [*found.tolist(), model.end]
                decimals = model.decimals
                rows.append((len(ids), hashlib.sha256(" ".join([decimals[i] for i in ids]).encode()).hexdigest(),
                             hashlib.sha256(model.decode(ids)).hexdigest(), hashlib.sha256(ends.astype("<i8").tobytes()).hexdigest(),
                             [dict(id=i, begin=b, end=e) for i, b, e in zip(found.tolist(), begins.tolist(), ends.tolist())] if with_pieces else None))
            made = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(v, t) for v, t in zip(made, kinds)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "pieces"])

    out = src.mapInArrow(go, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, "
                             "pieces array<struct<id int, begin bigint, end bigint>>")
    return out if with_pieces else out.drop("pieces")
