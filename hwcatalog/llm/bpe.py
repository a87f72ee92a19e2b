"""Byte-level BPE by dynamic programming over prefixes.

Every byte prefix of a piece has exactly one valid encoding, and so one valid last token. The table
keeps, for each prefix, that last token. A token t that ends at i is the last token of prefix i if the
pair (last token of prefix ``i - len(t)``, t) is stable: the bytes of the two tokens encode to just that
pair. So bytes can be appended without touching earlier entries, and after an edit only the entries
behind it are computed anew, up to where they agree with the old ones again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space in the tokenizers' regular expressions: the characters of the Unicode property, for a class.
WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces of more bytes are encoded one by one.
LONG = 24
#: The alternatives of the pattern whose matches never cross a single space between other characters, and for which a word, or a
#: word and a mark, is told without it (fixed by the tokenizers that use it). Texts are not cut for other patterns.
CUT = (" ?\\p{L}+", " ?\\p{N}+", " ?[^\\s\\p{L}\\p{N}]+", "\\s+(?!\\S)", "\\s+")


class Ranks:
    """A rank file: token bytes by id, and which pairs of tokens are stable."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        lengths: dict[int, set[int]] = {}
        for t in self.ids:
            lengths.setdefault(t[-1], set()).add(len(t))
        #: Lengths of the tokens that end in a byte, longest first.
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._stable: dict[int, bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self._parts:
            seq = [bytes([c]) for c in self.bytes[token]]
            while len(seq) > 2:
                _, i = min((self.ids.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(seq, seq[1:], strict=False)))
                seq[i : i + 2] = [seq[i] + seq[i + 1]]
            self._parts[token] = (self.ids[seq[0]], self.ids[seq[1]]) if len(seq) == 2 else None
        return self._parts[token]

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens, side by side, stay as they are when their bytes are encoded together."""
        key = left << 32 | right
        if (known := self._stable.get(key)) is None:
            if len(self._stable) >= 500_000:
                self._stable.clear()
            known = self._stable[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        """Unmake the later made of the two again and again: no merge over the border may come before its making."""
        before = 1 << 40
        while True:
            over = self.ids.get(self.bytes[left] + self.bytes[right])
            if over is not None and over < before:
                return False
            order = ((left, 0), (right, 1)) if left > right else ((right, 1), (left, 0))
            for token, side in order:
                if two := self.parts(token):
                    # of merges of one rank the leftmost comes first
                    before = token + side
                    left, right = (left, two[0]) if side else (two[1], right)
                    break
            else:
                return True


class PrefixTable:
    """The last token of every prefix of some bytes; grows by exact appends and follows edits."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Bytes at the end: earlier entries stay."""
        start = len(self.data)
        self.data += more
        self._fill(start, len(self.data))

    def _fill(self, start: int, end: int) -> None:
        ranks, data, last = self.ranks, self.data, self.last
        ids, lengths, stable = ranks.ids, ranks.lengths, ranks.stable
        for i in range(start + 1, end + 1):
            for n in lengths[data[i - 1]]:
                if n > i:
                    continue
                t = ids.get(data[i - n : i])
                if t is not None and (n == i or stable(last[i - n - 1], t)):
                    last.append(t)
                    break

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to end; returns how many entries were computed anew.

        An entry depends on the bytes and entries of one longest token before it, so once that many entries
        behind the edit equal the old ones, the rest is the old table.
        """
        tail, old = self.data[end:], self.last[end:]
        self.data, self.last = self.data[:start] + new + tail, self.last[:start]
        self._fill(start, start + len(new))
        done = agree = 0
        while done < len(tail) and agree < self.ranks.longest:
            at = start + len(new) + done
            self._fill(at, at + 1)
            agree = agree + 1 if self.last[at] == old[done] else 0
            done += 1
        self.last += old[done:]
        return len(new) + done

    def tokens(self) -> list[int]:
        """The encoding of all bytes, read off backwards."""
        out, i, size = [], len(self.last), self.ranks.bytes
        while i:
            out.append(self.last[i - 1])
            i -= len(size[out[-1]])
        return out[::-1]


def _merged(keys: np.ndarray, values: np.ndarray, more: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = np.concatenate([keys, more]), np.concatenate([values, theirs])
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


class TokenTable:
    """Token ids of byte slices, and whether pairs are stable, for whole arrays at once."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        rng = np.random.default_rng(5)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64)
        base = int(rng.integers(1, 2**62)) * 2 + 1
        self.up = np.array([pow(base, k, 2**64) for k in range(LONG + 1)], np.uint64)
        self.down = np.array([pow(base, -k, 2**64) for k in range(LONG + 1)], np.uint64)
        short = {t: i for t, i in ranks.ids.items() if len(t) <= LONG}
        with np.errstate(over="ignore"):
            sums = np.array([sum(int(self.byte[c]) * int(self.up[k]) for k, c in enumerate(t)) & (2**64 - 1) for t in short], np.uint64)
            keys = self._key(sums, np.array([len(t) for t in short], np.uint64))
            # of each token its sum and length, for the sums of pairs
            self.sums, self.sizes = np.zeros(max(ranks.bytes) + 1, np.uint64), np.zeros(max(ranks.bytes) + 1, np.int64)
            at = np.array(list(short.values()), np.int64)
            self.sums[at], self.sizes[at] = sums, [len(t) for t in short]
        #: The two tokens that each is made of, -1 for single bytes; -2 until they are asked for.
        self.parts = np.full((len(self.sums), 2), -2, np.int64)
        order = np.argsort(keys)
        self.keys, self.tokens = np.append(keys[order], ~np.uint64(0)), np.append(np.array(list(short.values()), np.int64)[order], -1)
        self.first = np.searchsorted(self.keys, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))
        #: Pairs already judged, sorted: many, and the latest; the first entry of either stands for no pair.
        self.known, self.holds = np.full(1, -1, np.int64), np.zeros(1, bool)
        self.fresh, self.fresh_holds = self.known, self.holds

    @staticmethod
    def _key(sums: np.ndarray, n) -> np.ndarray:
        x = (sums + n) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def slices(self, sums: np.ndarray, n) -> np.ndarray:
        """Token id, or -1, of slices of n bytes given by their sums."""
        keys = self._key(sums, np.asarray(n, np.uint64))
        at = self.first[(keys >> np.uint64(46)).astype(np.int64)]
        while (more := self.keys[at] < keys).any():
            at = at + more
        return np.where(self.keys[at] == keys, self.tokens[at], -1)

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        held = np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for known, holds in ((self.known, self.holds), (self.fresh, self.fresh_holds)):
            at = np.minimum(np.searchsorted(known, keys[open_]), len(known) - 1)
            found = known[at] == keys[open_]
            held[open_[found]] = holds[at[found]]
            open_ = open_[~found]
            if not len(open_):
                return held
        new, back = np.unique(keys[open_], return_inverse=True)
        told = self._borders_hold(new >> 32, new & 0xFFFFFFFF)
        held[open_] = told[back]
        self.fresh, self.fresh_holds = _merged(self.fresh, self.fresh_holds, new, told)
        if len(self.fresh) > 20_000:
            if len(self.known) > 2_000_000:
                self.known, self.holds = self.known[:1], self.holds[:1]
            self.known, self.holds = _merged(self.known, self.holds, self.fresh[1:], self.fresh_holds[1:])
            self.fresh, self.fresh_holds = self.fresh[:1], self.fresh_holds[:1]
        return held

    def _borders_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Ranks.stable`` of many pairs of at most LONG bytes together."""
        held, open_, before = np.ones(len(left), bool), np.arange(len(left)), np.full(len(left), 1 << 40)
        while len(open_):
            with np.errstate(over="ignore"):
                over = self.slices(self.sums[left] + self.sums[right] * self.up[self.sizes[left]], self.sizes[left] + self.sizes[right])
            breaks = (over >= 0) & (over < before)
            held[open_[breaks]] = False
            both = np.concatenate([left, right])
            for t in np.unique(both[self.parts[both, 0] == -2]).tolist():
                self.parts[t] = self.ranks.parts(t) or (-1, -1)
            has_left, has_right, later = self.parts[left, 0] >= 0, self.parts[right, 0] >= 0, left > right
            side = np.where(later, ~has_left, has_right)
            before = np.where(side, right + 1, left)
            left, right = np.where(side, left, self.parts[left, 1]), np.where(side, self.parts[right, 0], right)
            go = ~breaks & (has_left | has_right)
            open_, before, left, right = open_[go], before[go], left[go], right[go]
        return held

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The encodings, as bytes of 32-bit ids, of pieces of at most LONG bytes, longest first: the prefix tables of all, a prefix at a time."""
        size, k = len(pieces[0]), len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, k)
        data = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(k, size)
        with np.errstate(over="ignore"):
            total = np.zeros((size + 1, k), np.uint64)
            np.cumsum(self.byte[data].T * self.up[:size, None], axis=0, out=total[1:])
            last = np.full((size + 1, k), -1, np.int32)
            width = np.zeros((size + 1, k), np.int8)
            for i in range(1, size + 1):
                open_ = np.arange(np.searchsorted(-sizes, -i, "right"))
                for n in range(i, 0, -1):
                    tok = self.slices((total[i, open_] - total[i - n, open_]) * self.down[i - n], n)
                    hit = np.flatnonzero(tok >= 0)
                    if n < i and len(hit):
                        hit = hit[self.stable(last[i - n, open_[hit]].astype(np.int64), tok[hit])]
                    if len(hit):
                        last[i, open_[hit]], width[i, open_[hit]] = tok[hit], n
                        open_ = np.delete(open_, hit)
                        if not len(open_):
                            break
        # read off backwards, the last token of each piece in the last column
        ids, at, n = np.zeros((k, size), np.int32), sizes.copy(), np.zeros(k, np.int64)
        rows = np.arange(k)
        while len(rows):
            n[rows] += 1
            ids[rows, size - n[rows]] = last[at[rows], rows]
            at[rows] -= width[at[rows], rows]
            rows = rows[at[rows] > 0]
        data, ends = ids.tobytes(), np.arange(1, k + 1) * size * 4
        return [data[i:j] for i, j in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)]


class TextEncoder:
    """Encodes texts whose pieces are the matches of a pattern, as the tiktoken library does without special tokens.

    A text is cut at single spaces between other characters, where no match of the pattern crosses. The
    encodings of these cuts are remembered within a fixed number of entries; new ones of a run of texts are
    computed together.
    """

    def __init__(self, path: str, pattern: str, remembered: int = 600_000):
        self.ranks = Ranks(path)
        self.table = TokenTable(self.ranks)
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{WS}").replace(r"\s", f"[{WS}]").replace(r"\S", f"[^{WS}]"))
        self.plain = tuple(x for x in pattern.split("|") if not re.fullmatch(r"'(?:\w+|\(\?:\[?\w+\]?)\)?", x)) == CUT
        self.odd = re.compile(rf"\A | \Z| [{WS}]|[{WS}] ")
        #: What ``cuts`` has to see to, in the syntax of Arrow's expressions: odd spaces, a NUL, no text.
        ws = WS.encode().decode("unicode_escape")
        self.special = rf"\A | \z| [{ws}]|[{ws}] |\x00|\A\z"
        self.space = re.compile(rf"(?<=[^{WS}]) (?=[^{WS}])")
        order = range(max(self.ranks.bytes) + 1)
        #: What an id is written as, by id: its bytes, and a space with its decimal digits.
        self.bytes = pa.array([self.ranks.bytes.get(i, b"") for i in order], pa.binary())
        self.digits = pa.array([b" %d" % i for i in order], pa.binary())
        #: Encodings of cuts, as bytes of 32-bit ids, in two generations; the older goes when the newer is full.
        self.half, self.seen, self.old = remembered // 2, {}, {}

    def _encode_pieces(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """The encodings of pieces, as bytes of 32-bit ids."""
        out, rest = {}, []
        for p in pieces:
            whole = self.ranks.ids.get(p)
            if whole is not None:
                out[p] = whole.to_bytes(4, sys.byteorder)
            elif len(p) > LONG:
                out[p] = np.array(PrefixTable(self.ranks, p).tokens(), np.int32).tobytes()
            else:
                rest.append(p)
        rest.sort(key=len, reverse=True)
        for i in range(0, len(rest), 20_000):
            out.update(zip(rest[i : i + 20_000], self.table.encode(rest[i : i + 20_000]), strict=True))
        return out

    def _split(self, part: str) -> list[bytes]:
        """The pieces of a cut; most are a word, or a word and a mark."""
        word = part[1:] if part[:1] == " " else part
        if not self.plain:
            return [p.encode("utf-8", "replace") for p in self.pieces.findall(part)]
        if word.isalpha():
            return [part.encode()]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return [part[:-1].encode(), part[-1].encode()]
        return [p.encode("utf-8", "replace") for p in self.pieces.findall(part)]

    def cuts(self, text: str | None) -> list[str]:
        """The text in cuts, the first behind a NUL, the others with the space before them left off unless they begin with a NUL.

        No cut but the first begins with white space, so what a cut is shows in its first character.
        """
        if not text:
            return []
        if not self.plain:
            return ["\0" + text]
        rest = self.space.split(text) if self.odd.search(text) else text.split(" ")
        first = rest.pop(0)
        if "\0" in text:
            rest = [" " + c if c[0] == "\0" else c for c in rest]
        rest.insert(0, "\0" + first)
        return rest

    def _words(self, texts: list[str | None]) -> pa.ListArray:
        """The cuts of each text; most texts are cut by Arrow."""
        try:
            whole = pa.array([x or "" for x in texts], pa.string())
        except UnicodeEncodeError:  # lone surrogates become question marks, which are marks too
            return self._words([x and x.encode("utf-8", "replace").decode() for x in texts])
        special = pc.match_substring_regex(whole, self.special) if self.plain else pa.array([True] * len(texts), pa.bool_())
        out = pc.split_pattern(pc.binary_join_element_wise("\0", whole.filter(pc.invert(special)), ""), " ")
        if len(out) < len(texts):
            at = special.to_numpy(zero_copy_only=False)
            out = pa.concat_arrays([out, pa.array([self.cuts(texts[k]) for k in np.flatnonzero(at)], out.type)])
            out = out.take(pa.array(np.argsort(np.argsort(at, kind="stable"))))
        return out

    def encode_lists(self, texts: list[str | None]) -> pa.ListArray:
        """Token ids of whole texts, a list a text. Very long texts take memory in proportion, all else is bounded.

        Arrow tells the cuts of all texts apart, so only distinct ones are looked up here, and puts the lists together by their numbers.
        """
        words = self._words(texts)
        coded, seen = words.flatten().dictionary_encode(), self.seen
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(seen.get, distinct))
        new = [(k, c) for k, c in enumerate(distinct) if found[k] is None]
        split = {}
        for k, c in new:
            if (known := self.old.get(c)) is not None:
                found[k] = seen[c] = known
            else:
                split[k] = self._split(c[1:] if c[0] == "\0" else c if c[0] == " " else " " + c)
        ids = self._encode_pieces({p for x in split.values() for p in x})
        for k, x in split.items():
            found[k] = ids[x[0]] if len(x) == 1 else b"".join(map(ids.__getitem__, x))
            if len(c := distinct[k]) < 64 and c[0] != "\0":  # others are unlikely to come again
                seen[c] = found[k]
        if len(seen) > self.half:
            self.seen, self.old = {}, seen
        ends = lambda sizes: np.cumsum(np.fromiter(chain((0,), map(len, sizes)), np.int64, len(sizes) + 1))
        table = pa.LargeListArray.from_arrays(pa.array(ends(found) // 4), pa.array(np.frombuffer(b"".join(found), np.int32)))
        lists = table.take(coded.indices)
        return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[words.offsets.to_numpy()], pa.int32()), lists.values)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of whole texts."""
        return self.encode_lists(texts).to_pylist()

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, ids))

    def written(self, ids: pa.Array, table: pa.BinaryArray, most: int = 1 << 20):
        """What ``table`` has for the ids, end to end, in buffers of at most so many ids."""
        for i in range(0, len(ids), most):
            yield table.take(ids.slice(i, most)).buffers()[2]

    def digests(self, ids: pa.Array) -> tuple[str, str]:
        """SHA-256 of the decimal ids joined by one space, and of the decoded bytes."""
        a, b = hashlib.sha256(), hashlib.sha256()
        for k, x in enumerate(self.written(ids, self.digits)):
            a.update(memoryview(x)[k == 0 :])
        for x in self.written(ids, self.bytes):
            b.update(x)
        return a.hexdigest(), b.hexdigest()


def runs(texts: list[str | None], most: int = 4_000_000):
    """Cut a list of texts into runs of about ``most`` characters: (first, after last)."""
    i = held = 0
    for k, x in enumerate(texts):
        held += len(x or "")
        if held >= most:
            yield i, k + 1
            i, held = k + 1, 0
    if i < len(texts):
        yield i, len(texts)


_encoders: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder per Python worker, rank file and pattern."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of its texts as array<int>; null texts count as empty. A column named as ``ids`` is replaced."""
    docs = docs.drop(ids)
    at = docs.columns.index(text)

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, j in runs(texts):
                part = batch.slice(i, j - i)
                lists = enc.encode_lists(texts[i:j])
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``rows`` with the bytes of their ids; null ids count as none. An id outside the vocabulary is an error."""
    rows = rows.drop(out)
    at = rows.columns.index(ids)

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            found = pa.array([enc.decode(x or ()) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded bytes, both bare
    lower-case hex. Null texts are empty: no tokens, and the digests of nothing. Rows, repeated ones too, are
    independent of each other; a null doc_id stays null.
    """

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            rows, texts = [], batch.column(1).to_pylist()
            for i, j in runs(texts):
                lists = enc.encode_lists(texts[i:j])
                ends = lists.offsets.to_pylist()
                rows += ((b - a, *enc.digests(lists.values.slice(a, b - a))) for a, b in zip(ends, ends[1:], strict=False))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
