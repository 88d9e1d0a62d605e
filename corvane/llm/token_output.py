"""Token ids in sorted-string-table shards."""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, map_batches, shuffle_partitions, slices, tidy
from corvane.llm.merges import LONGEST, Merges

MAGIC = b"CVSSTB01"
BLOCK = 64 << 10
END = 0
#: Parts whose ids are remembered in a worker, some 200 bytes each.
REMEMBERED = 200_000
#: Bytes of text that are encoded at a time.
GROUP = 4 << 20
#: What a byte is in a part whose pre-tokens are runs of one kind.  Letters are those of ASCII and, in two bytes, of U+00C0 to U+024F and
#: U+0400 to U+047F; two signs among these, other characters, and the apostrophe, which may begin a pre-token of a letter or two, make a part OTHER.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[[32, 39]] = SPACE, OTHER
KIND[48:58] = DIGIT
KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA), 0xD0, 0xD1]] = LETTER


class Encoder:
    """Ids of whole texts by a byte-level BPE file of ``tokenizers``, encoding each distinct word of a group of texts once.

    In such a tokenizer a space or newline that stands alone between two other characters always
    starts, or is, a pre-token of its own, so a text may be cut there and the parts' ids are the text's.
    Parts are cut, told apart and put together again as Arrow arrays.  Those of letters, digits and signs whose bytes tell
    their class (``KIND``) are split into pre-tokens and merged as arrays too, by the model's own merges.

    The others are split by the published pattern, since the library's splitter is the slow part, and the library's BPE model
    encodes them; ids of those that come more than once in a group are remembered, up to ``limit``; then all but the
    frequent ones of the group at hand are forgotten.  Words with characters above ``SAFE`` (whose classes may differ between
    Unicode versions), texts with other white space, and texts that hold the string of an added (special) token, which gets that
    token's id by the library's default, go through the library whole.
    """

    SAFE = "ɏ"

    def __init__(self, path: str, limit: int = REMEMBERED):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bpe = Tokenizer(self.whole.model)  # the same model, held once
        # strings that the library finds in a text before it is split, such as those of special tokens
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.bpe.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.unsafe = re.compile(f"[^\\0-{self.SAFE}]").search
        self.newline = self.whole.encode("\n", add_special_tokens=False).ids
        self.line = np.array(self.newline, "<u4").tobytes()
        self.known: dict[str, bytes] = {}
        self.limit = limit
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        alphabet = np.arange(256, dtype="<u4")
        alphabet[others] = 256 + np.arange(len(others))
        self.space, self.line_sign = chr(alphabet[32]), chr(alphabet[10])
        self.merges = Merges.of(self.whole, list(map(chr, alphabet.tolist())))
        self.behind, self.apart = alphabet.copy(), alphabet.copy()
        self.behind[10] = 32  # words hold no newline: it parts pre-tokens
        self.apart[32] = 32  # nor a space: that parts those of bare words
        self.opens = np.zeros(self.whole.get_vocab_size(), bool)
        self.opens[[i for t, i in self.whole.get_vocab().items() if t.startswith(self.space)]] = True
        if len(self.newline) != 1:
            raise ValueError("not a byte-level tokenizer")

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[str], before: str) -> dict[str, bytes]:
        """Ids of distinct parts, all of which are ``before`` (a space or nothing) and a word."""
        out: dict[str, bytes] = {}
        letters = list(map(str.isalpha, [p[1:] for p in parts] if before else parts))
        alone = list(compress(parts, letters))  # letters alone are one pre-token
        plain = list(compress(parts, map(not_, letters)))
        for group, split in ((alone, False), (plain, True)):
            latin = list(map(str.isascii, group))  # together, since ASCII needs no translation
            other = list(compress(group, map(not_, latin)))
            if self.unsafe("".join(other)):
                out |= {p: self._ids(p) for p in other if self.unsafe(p)}
                other = [p for p in other if p not in out]
            self._learn_plain(list(compress(group, latin)), out, before, split)
            self._learn_plain(other, out, before, split)
        return out

    def _learn_plain(self, parts: list[str], out: dict[str, bytes], before: str, split: bool) -> None:
        for lo in range(0, len(parts), 500):
            part = parts[lo : lo + 500]
            text = "".join(part) if before else "\n".join(part) + "\n"
            # pre-tokens in the byte-level alphabet, parted by white space that the alphabet doesn't hold
            if before:
                mapped = "\n".join(self.find(text)) if split else text.replace(" ", "\n ")[1:]
            else:
                mapped = " ".join(self.find(text))
            if text.isascii() and mapped.replace("\n", "").isprintable():
                mapped = mapped.replace(" ", self.space).replace("\n", " ") if before else mapped.replace("\n", self.line_sign)
            else:
                table = self.behind if before else self.apart
                mapped = table[np.frombuffer(mapped.encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.bpe.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            if before:  # each part's first id is the one that starts with a space
                start = np.flatnonzero(self.opens[ids])
                end = np.append(start[1:], len(ids))
            else:  # bare words are told apart by the newline's id
                end = np.flatnonzero(ids == self.newline[0])
                start = np.append(0, end[:-1] + 1)
            if len(end) != len(part):
                for p in part:
                    out[p] = self._ids(p)
                continue
            raw = ids.tobytes()
            for p, x, y in zip(part, (start * 4).tolist(), (end * 4).tolist(), strict=True):
                out[p] = raw[x:y]

    def _parts(self, parts: pa.Array, counts: np.ndarray) -> pa.Array:
        """Ids of distinct parts (a word, a space and a word, or a newline) that come ``counts`` times."""
        offset = _offsets(parts)
        buf = np.frombuffer(parts.buffers()[2], np.uint8)[offset[0] : offset[-1]]
        offset = offset - offset[0]
        odd, start = self._pieces(buf, offset)
        first = np.searchsorted(start, offset)
        plain = np.ones(len(start), bool)
        plain[first[:-1][odd]] = False
        count = np.zeros(len(start), np.int64)
        ids = np.zeros(0, "<u4")
        if plain.any():
            ids, count[plain] = self.merges.ids(buf, start[plain], np.diff(start, append=len(buf))[plain])
        if odd.any():
            others = self._others(parts.filter(pa.array(odd)).to_pylist(), counts[odd])
            count[~plain] = [len(v) // 4 for v in others]
            both, merged = np.empty(int(count.sum()), "<u4"), np.repeat(plain, count)
            both[merged], both[~merged] = ids, np.frombuffer(b"".join(others), "<u4")
            ids = both
        at = np.append(0, np.cumsum(count))[first] * 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(at), pa.py_buffer(ids)])

    def _pieces(self, buf: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which parts can't be split by their bytes alone, and where pre-tokens begin; such a part counts as one."""
        kind = KIND.take(buf)
        begin = np.zeros(len(buf), bool)
        begin[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)  # a space belongs to the pre-token behind it
        size = np.diff(offset)
        odd = size > LONGEST if self.merges else np.ones(len(size), bool)
        lead = np.flatnonzero((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)) | (buf[:-1] == 0xC9) & (buf[1:] > 0x8F))
        for at in (lead, np.flatnonzero(kind == OTHER)):
            odd[np.searchsorted(offset, at, side="right") - 1] = True
        if odd.any():
            begin[np.repeat(odd, size)] = False
        begin[offset[:-1]] = True
        return odd, np.flatnonzero(begin)

    def _others(self, parts: list[str], counts: np.ndarray) -> list[bytes]:
        """Ids of distinct parts, by the library."""
        found = list(map(self.known.get, parts))
        new = [p for p, v in zip(parts, found, strict=True) if v is None]
        ids = self._learn([p for p in new if p[0] == " "], " ")
        ids |= self._learn([p for p in new if p[0] != " " and p != "\n"], "")
        ids["\n"] = self.line
        found = [ids[p] if v is None else v for p, v in zip(parts, found, strict=True)]
        often = np.flatnonzero(counts > 1)
        if len(often) > self.limit:
            often = often[np.argsort(-counts[often], kind="stable")[: self.limit]]
        often = {parts[i]: found[i] for i in often.tolist()}
        self.known |= often
        if len(self.known) > self.limit:
            self.known = often
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        return list(self.encode_column(pa.array(texts, pa.large_string())))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, group by group; null is empty."""
        for group in slices(pa.RecordBatch.from_arrays([texts.cast(pa.large_string())], ["text"]), 0, GROUP):
            yield from self._group(pc.fill_null(group.column(0), ""))

    def _group(self, texts: pa.Array) -> Iterator[bytes]:
        odd = _irregular(texts)
        for a in self.added:
            odd |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if not odd.any():
            yield from self._regular(texts)
            return
        mended = iter(self._mended(texts.filter(pa.array(odd)).to_pylist()))
        rest = self._regular(texts.filter(pa.array(~odd)))
        for x in odd.tolist():
            yield next(mended if x else rest)

    def _regular(self, texts: pa.Array) -> Iterator[bytes]:
        """Texts whose white space is lone spaces and lone newlines, neither first nor last."""
        if pc.sum(pc.binary_length(texts)).as_py():
            ids, cuts = self._joined(texts)
            raw = memoryview(ids.buffers()[2])
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                yield bytes(raw[x:y])
        else:
            yield from [b""] * len(texts)

    def _joined(self, texts: pa.Array) -> tuple[pa.Array, list[int]]:
        """Ids of all parts of texts that aren't all empty, and where each text's ids begin and end in their buffer."""
        first, indices, parts = self._cut(texts)
        counts = np.bincount(indices.to_numpy(), minlength=len(parts))
        ids = self._parts(parts, counts).take(indices)
        return ids, _offsets(ids)[first].tolist()

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Each text's first part, which distinct part each part is, and the distinct parts; what the cut takes besides is freed here."""
        offset = _offsets(texts)
        buf = np.frombuffer(texts.buffers()[2], np.uint8)[offset[0] : offset[-1]]
        offset = offset - offset[0]
        line = buf == 10
        cut = line | (buf == 32)
        cut[1:] |= line[:-1]
        cut[offset[:-1][offset[:-1] < offset[1:]]] = True
        at = np.flatnonzero(cut)
        first = np.searchsorted(at, offset)
        del line, cut
        parts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(buf))), pa.py_buffer(buf)).dictionary_encode()
        return first, parts.indices, parts.dictionary

    def _mended(self, texts: list[str]) -> list[bytes]:
        """Texts with other white space: cut at lone separators all the same, each part encoded once.

        One with the string of an added token goes through the library as it is, which is the definition of its ids.
        """
        cut = [None if any(a in t for a in self.added) else LONE.split(t) for t in texts]
        count = Counter(p for parts in cut if parts for p in parts)
        plain = [p for p in count if len(p.split()) == 1 and not p[-1].isspace() and (p[0] == " " and not p[1].isspace() or not p[0].isspace())]
        ids = {}
        if plain:
            found = self._parts(pa.array(plain, pa.large_string()), np.array([count[p] for p in plain], np.int64))
            ids = dict(zip(plain, found.to_pylist(), strict=True))
        for p in count:
            if p not in ids:
                ids[p] = self._ids(p)
        return [self._ids(t) if parts is None else b"".join([ids[p] for p in parts]) for t, parts in zip(texts, cut, strict=True)]


#: Before a lone space, and around a lone newline.
LONE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: White space of three bytes in UTF-8, and the first two of these.
WIDE = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
WIDE_BYTES = ((0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the values of a large string or binary array begin and end in its buffer."""
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def _irregular(texts: pa.Array) -> np.ndarray:
    """Which texts hold white space other than lone spaces and newlines, or begin or end with one."""
    offset = _offsets(texts)
    odd = np.zeros(len(texts), bool)
    if offset[0] == offset[-1]:
        return odd
    buf = np.frombuffer(texts.buffers()[2], np.uint8)[offset[0] : offset[-1]]
    offset = offset - offset[0]

    def owners(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(offset, at, side="right") - 1

    sep = (buf == 32) | (buf == 10)
    some = offset[:-1] < offset[1:]
    odd[some] = sep[offset[:-1][some]] | sep[offset[1:][some] - 1]
    odd[owners(np.flatnonzero(sep[:-1] & sep[1:]))] = True  # of two texts' separators both texts are odd anyway
    low = np.flatnonzero(buf < 32)
    low = low[buf[low] != 10]
    odd[owners(low[((buf[low] >= 9) & (buf[low] <= 13)) | (buf[low] >= 28)])] = True
    lead = np.flatnonzero(buf[:-1] == 0xC2)
    odd[owners(lead[(buf[lead + 1] == 0x85) | (buf[lead + 1] == 0xA0)])] = True
    lead = np.flatnonzero((buf[:-1] >= 0xE1) & (buf[:-1] <= 0xE3))
    maybe = np.zeros(len(lead), bool)
    for x, y in WIDE_BYTES:
        maybe |= (buf[lead] == x) & (buf[lead + 1] == y)
    for i in np.unique(owners(lead[maybe])).tolist():
        odd[i] |= WIDE(texts[i].as_py()) is not None
    return odd


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- file format -------------------------------------------------------------
#
#   magic | block ... | index | Bloom filter | footer
#   block   zstd of entries; an entry is (shared, own, value bytes) as varints, own key bytes, value
#   index   zstd of (first key, offset, length) for each block
#   footer  six little-endian 64-bit numbers: index offset and length, filter offset and length, entries, ids; then magic
#
# Keys are doc_ids as 8 big-endian bytes, the sign bit turned, behind 0x01; a null doc_id is the one byte 0x00.


def to_key(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + 2**63)


def from_key(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, k: int = 7) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(k)]


class TableWriter:
    """Writes ascending keys; memory is one block, the sparse index and ten filter bits a key."""

    def __init__(self, out, block: int = BLOCK):
        self.out, self.block, self.at = out, block, 0
        self.entries, self.size, self.last = [], 0, b""
        self.index, self.keys, self.n, self.ids = [], [], 0, 0
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def add(self, key: bytes, value: bytes) -> None:
        if not self.entries:
            self.first, self.last = key, b""
        shared = 0
        for x, y in zip(key, self.last, strict=False):
            if x != y:
                break
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries.append(entry)
        self.size += len(entry)
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.n += 1
        self.ids += len(value) // 4
        if self.size >= self.block:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            z = zstandard.ZstdCompressor(level=1).compress(b"".join(self.entries))
            self.index.append((self.first, self.at, len(z)))
            self._put(z)
            self.entries, self.size = [], 0

    def close(self) -> None:
        self._flush()
        raw = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        index = zstandard.ZstdCompressor().compress(raw)
        bits = max(64, 10 * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_probes(k, bits)] = 1
        bloom = np.packbits(bloom).tobytes()
        where = (self.at, len(index), self.at + len(index), len(bloom), self.n, self.ids)
        self._put(index)
        self._put(bloom)
        self._put(struct.pack("<6Q", *where) + MAGIC)


class TableReader:
    """Opens a shard by its footer; a lookup reads the filter, the index and the blocks that may hold the key."""

    def __init__(self, source):
        self.f = source
        size = source.size()
        tail = self._at(size - 56, 56)
        if tail[48:] != MAGIC:
            raise ValueError("not a shard")
        self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.n, self.ids = struct.unpack("<6Q", tail[:48])
        self._index = self._bloom = None

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def index(self) -> list[tuple[bytes, int, int]]:
        if self._index is None:
            raw, at, out = zstandard.ZstdDecompressor().decompress(self._at(self.index_at, self.index_len)) if self.index_len else b"", 0, []
            while at < len(raw):
                n, at = _read_varint(raw, at)
                key, at = raw[at : at + n], at + n
                o, at = _read_varint(raw, at)
                n, at = _read_varint(raw, at)
                out.append((key, o, n))
            self._index = out
        return self._index

    def _entries(self, at: int, n: int) -> Iterator[tuple[bytes, bytes]]:
        raw, i, key = zstandard.ZstdDecompressor().decompress(self._at(at, n)), 0, b""
        while i < len(raw):
            shared, i = _read_varint(raw, i)
            own, i = _read_varint(raw, i)
            size, i = _read_varint(raw, i)
            key = key[:shared] + raw[i : i + own]
            i += own
            yield key, raw[i : i + size]
            i += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, n in self.index():
            yield from self._entries(at, n)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all records with this key (one, but for repeated doc_ids)."""
        key = to_key(doc_id)
        if self._bloom is None:
            self._bloom = np.unpackbits(np.frombuffer(self._at(self.bloom_at, self.bloom_len), np.uint8))
        if not self._bloom[_probes(key, len(self._bloom))].all():
            return []
        index = self.index()
        out = []
        i = max(0, bisect.bisect_left(index, (key,)) - 1)
        while i < len(index) and index[i][0] <= key:
            out += [np.frombuffer(v, "<u4") for k, v in self._entries(*index[i][1:]) if k == key]
            i += 1
        return out


def _write(root: str, tokenizer: str, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        enc = encoder(tokenizer)
        tail = struct.pack("<I", end)
        system, path = fs.FileSystem.from_uri(root)
        final = f"{path}/shard-{ctx.partitionId():06d}.sst"
        part = f"{path}/.part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        writer, first, last = None, None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if writer is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(part)
                writer, first = TableWriter(out, block), ids[0]
            for i, v in zip(ids, enc.encode_column(batch.column(1)), strict=True):
                writer.add(to_key(i), v + tail)
            last = ids[-1]
        if writer is not None:
            writer.close()
            out.close()
            try:  # a second attempt writes the same bytes to the same name; not every store replaces on a move
                system.move(part, final)
            except OSError:
                system.delete_file(final)
                system.move(part, final)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ctx.partitionId()], pa.int32()), pa.array([final]), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([writer.n], pa.int64()), pa.array([writer.ids], pa.int64())],
                ["shard", "file", "first_id", "last_id", "n_docs", "n_tokens"],
            )

    return tidy(run)


def write_token_shards(
    docs: DataFrame, folder: str, tokenizer: str, end: int = END, shards: int | None = None, block: int = BLOCK
) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into shards of ``folder``, in ascending doc_id order; returns their manifest.

    Texts are dealt by ranges of (doc_id, text hash), so shard k's keys come before shard k + 1's, and repeated doc_ids
    don't gather in one shard unless their texts repeat too.  Each task sorts its range, encodes it and streams
    it to a file that gets its name only when complete: a lost executor leaves no half shard.  ``folder`` is
    any URI that pyarrow opens.  Manifest, written beside the shards: ``shard, file, first_id, last_id, n_docs, n_tokens, start`` with
    ``start`` the ids in all earlier shards (one row a shard).

    Null texts are empty, so they hold the ``end`` id alone; a null doc_id comes first.
    """
    spark = docs.sparkSession
    n = shards or shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    shard = map_batches(dealt, _write(folder, tokenizer, end, block), "shard int, file string, first_id long, last_id long, n_docs long, n_tokens long")
    path = f"{folder}/manifest"
    shard.write.parquet(path)
    start = F.expr("coalesce(sum(n_tokens) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return spark.read.schema(shard.schema).parquet(path).withColumn("start", start)  # one row a shard


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[list] = [[], [], [], []]
                size = 0
                with system.open_input_file(file) as f:
                    for key, value in TableReader(f):
                        for col, x in zip(rows, (from_key(key), start, len(value) // 4, value), strict=True):
                            col.append(x)
                        start += len(value) // 4
                        size += len(value)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [[], [], [], []], 0
                if rows[0]:
                    yield _batch(rows)

    def _batch(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    return tidy(run)


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every record; ``ids`` are little-endian 32-bit numbers."""
    files = manifest.select("file", "start")
    spark = manifest.sparkSession
    files = files.repartition(shuffle_partitions(spark), "file")
    return map_batches(files, _read(folder), "doc_id long, start long, n_tokens long, ids binary")


def tokenised(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    root = Scratch(docs.sparkSession, "tokens").root
    return read_token_shards(write_token_shards(docs, root, tokenizer, end), root)
