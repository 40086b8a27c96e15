"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

Three predictors say what comes next: the id last seen after the same two ids
(order 2), after the same id (order 1), and the file's id frequencies (order 0).
Their weights adapt with what proves right for each pair of confidences; a
range coder spends the mixed probability, one interval for each id.
Every block starts from the same state, so blocks decode alone, and numpy
works on many blocks in lockstep: one array operation codes one id of each.

File: magic, sizes, zlib'd header (document ids and lengths, id frequencies,
block lengths and crc32 sums), then the blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import fresh_path, materialize, release, small_batches

MAGIC = b"CWTOKENS1\n"
#: Ids of a block, blocks coded in lockstep, and bytes of text that go to one file, about.
BLOCK_IDS, LANES, FILE_CHARS = 2048, 2048, 10_000_000
#: Bytes of text that are tokenized at a time.
BATCH_BYTES = 8_000_000
_H1, _H2 = 9, 10
#: Bits of a mixing probability, of a file frequency, and of the coder's state.
_MIX, _FREQ, _STATE = 12, 18, 48
_ONE, _MASK, _LEAST = 1 << _MIX, np.int64((1 << _STATE) - 1), 1 << (_STATE - 16)


class _Model:
    """The predictors' state for a number of blocks, all in the same state at first.

    An entry of the order-1 and order-2 tables is an id, shifted by two, and a
    confidence of 0 to 3. ``hit2`` and ``hit1`` are the chances, for each pair of
    confidences and whether both predict the same, that order 2 is right, and
    that order 1 is where order 2 is not; what is left is order 0.
    """

    def __init__(self, lanes: int):
        # 32-bit integers throughout, but for what indexes; the chances of one context lie side by side.
        row = np.arange(lanes, dtype=np.int64)
        self.at1, self.at2, self.at, self.lanes = row << _H1, row << _H2, row, lanes
        self.t1, self.t2 = np.full(lanes << _H1, -4, np.int32), np.full(lanes << _H2, -4, np.int32)
        self.hit2, self.hit1 = np.full(lanes << 5, _ONE >> 3, np.int32), np.full(lanes << 5, _ONE >> 3, np.int32)
        self.prev = np.zeros(lanes, np.int64)
        self.mixed = np.zeros(lanes, np.int64)

    def predict(self):
        """(order-2 id, order-1 id, their weights); an id is -1 where there is none."""
        h = self.prev * 40503
        self.s1 = ((h >> 4) & ((1 << _H1) - 1)) + self.at1
        h += self.mixed
        self.s2 = ((h >> 5) & ((1 << _H2) - 1)) + self.at2
        self.e1, self.e2 = self.t1.take(self.s1), self.t2.take(self.s2)
        p1, p2 = self.e1 >> 2, self.e2 >> 2
        self.c1, self.c2 = self.e1 & 3, self.e2 & 3
        self.ctx = ((self.c2 << 3) + (self.c1 << 1) + (p1 == p2)) * np.int64(self.lanes) + self.at
        self.a, self.b = self.hit2.take(self.ctx), self.hit1.take(self.ctx)
        # No weight is ever 0.
        w2 = ((self.a * 4000) >> _MIX) + 16
        return p2, p1, w2, (((_ONE - 16 - w2) * self.b) >> _MIX) + 8

    def update(self, ids: np.ndarray, eq2: np.ndarray, eq1: np.ndarray) -> None:
        """``ids`` came (64 bits); ``eq2`` and ``eq1`` say which orders had predicted them."""
        i2, i1 = eq2.astype(np.int32), eq1.astype(np.int32)
        self.hit2[self.ctx] = self.a + (((i2 << _MIX) - self.a) >> 5)
        self.hit1[self.ctx] = self.b + (((i1 << _MIX) - self.b) >> 5) * (1 - i2)
        fresh = (ids.astype(np.int32) << 2) + 1
        for table, slot, e, c, eq in ((self.t1, self.s1, self.e1, self.c1, eq1), (self.t2, self.s2, self.e2, self.c2, eq2)):
            table[slot] = np.where(eq, np.minimum(e + 1, e | 3), np.where(c > 1, e - 1, fresh))
        self.mixed = self.prev * 60493
        self.prev = ids


def frequencies(count: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**_FREQ, each that isn't 0 to 1 at least."""
    freq = np.zeros(len(count), np.int64)
    used = count > 0
    if used.any():
        room = (1 << _FREQ) - int(used.sum())
        freq[used] = 1 + count[used] * room // int(count.sum())
        freq[count.argmax()] += (1 << _FREQ) - int(freq.sum())
    return freq


def encode_blocks(ids: np.ndarray, n: np.ndarray, freq: np.ndarray) -> list[bytes]:
    """A stream for each row of ids (lanes, length), of which the first n count."""
    lanes, longest = len(n), int(n.max())
    model = _Model(lanes)
    freq = freq.astype(np.int64)
    below = np.cumsum(freq) - freq
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, 1 << _STATE, np.int64)
    width = 3 * longest + 8
    out, pos = np.zeros(lanes * width, np.uint16), np.arange(lanes, dtype=np.int64) * width
    first = pos.copy()
    ids = np.ascontiguousarray(ids.T).astype(np.int64)
    least = int(n.min())
    for t in range(longest):
        s = ids[t]
        p2, p1, w2, w1 = model.predict()
        eq2, eq1 = s == p2, s == p1
        w2, w1 = w2.astype(np.int64), w1.astype(np.int64)
        w0 = _ONE - w2 - w1
        w2 <<= _FREQ
        w1 <<= _FREQ
        start = (w1 + w0 * below.take(s)) * ~eq1 + w2
        start *= ~eq2
        size = np.where(eq2, w2, np.where(eq1, w1, w0 * freq.take(s)))
        r = rng >> (_MIX + _FREQ)
        if t >= least:
            live = n > t
            start, size = np.where(live, start, 0), np.where(live, size, 0)
            rng = np.where(live, r * size, rng)
        else:
            rng = r * size
        low += r * start
        carry = np.flatnonzero(low > _MASK)
        if len(carry):
            low[carry] &= _MASK
            at = pos[carry] - 1
            while len(at):
                out[at] += 1
                at = at[out[at] == 0] - 1
        # All lanes write their next word; it stays in those that move on.
        more = rng < _LEAST
        while more.any():
            out[pos] = low >> (_STATE - 16)
            pos += more
            by = more.astype(np.int64) << 4
            low = (low << by) & _MASK
            rng <<= by
            more = rng < _LEAST
        model.update(s, eq2, eq1)
    ends = np.stack([low >> 32, (low >> 16) & 0xFFFF, low & 0xFFFF], 1)
    return [np.append(out[first[k] : pos[k]], ends[k]).astype("<u2").tobytes() for k in range(lanes)]


def decode_blocks(streams: list[bytes], n: np.ndarray, freq: np.ndarray) -> np.ndarray:
    lanes, longest = len(n), int(n.max())
    model = _Model(lanes)
    freq = freq.astype(np.int64)
    below = np.cumsum(freq) - freq
    at = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    # All streams in a row; a lane that is done may read on into the next one's words.
    sizes = np.array([len(x) // 2 for x in streams], np.int64)
    words = np.concatenate([np.frombuffer(b"".join(streams), "<u2"), np.zeros(longest + 4, np.uint16)])
    pos = np.cumsum(sizes) - sizes
    word = lambda k: words.take(k).astype(np.int64)
    code, rng = (word(pos) << 32) | (word(pos + 1) << 16) | word(pos + 2), np.full(lanes, 1 << _STATE, np.int64)
    pos += 3
    last = len(words) - 1
    out = np.zeros((longest, lanes), np.int32)
    least = int(n.min())
    for t in range(longest):
        p2, p1, w2, w1 = model.predict()
        w2, w1 = w2.astype(np.int64), w1.astype(np.int64)
        w0 = _ONE - w2 - w1
        w2 <<= _FREQ
        w1 <<= _FREQ
        top = w2 + w1
        r = rng >> (_MIX + _FREQ)
        v = np.minimum(code // r, (1 << (_MIX + _FREQ)) - 1)
        is2 = v < w2
        is1 = (v < top) > is2
        s = np.where(is2, p2, np.where(is1, p1, at.take(np.maximum(v - top, 0) // w0))).astype(np.int64)
        live = n > t
        if t >= least:
            s = np.where(live, s, 0)
        start = (w1 + w0 * below.take(s)) * ~is1 + w2
        start *= ~is2
        size = np.where(is2, w2, np.where(is1, w1, w0 * freq.take(s)))
        if t >= least:
            start = np.where(live, start, 0)
            rng = np.where(live, r * size, rng)
        else:
            rng = r * size
        code -= r * start
        more = rng < _LEAST
        while more.any():
            by = more.astype(np.int64) << 4
            code = np.where(more, (code << 16) | words.take(pos), code)
            pos = np.minimum(pos + more, last)
            rng <<= by
            more = rng < _LEAST
        out[t] = s
        model.update(s, s == p2, s == p1)
    return out.T


def pack_file(doc_ids: list, docs: list[np.ndarray]) -> bytes:
    """The bytes of a file that holds these documents in this order; ids below 65536."""
    return pack_flat(doc_ids, np.array([len(x) for x in docs], "<u4"), np.concatenate([np.empty(0, np.uint16), *docs]))


def pack_flat(doc_ids: list, sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """As ``pack_file``, of the documents' sizes and all their ids in a row."""
    sizes = sizes.astype("<u4")
    count = np.bincount(flat, minlength=1)
    freq = frequencies(count)
    n_blocks = -(-len(flat) // BLOCK_IDS)
    n = np.full(n_blocks, BLOCK_IDS)
    if n_blocks:
        n[-1] = len(flat) - BLOCK_IDS * (n_blocks - 1)
    grid = np.zeros(n_blocks * BLOCK_IDS, np.uint16)
    grid[: len(flat)] = flat
    grid = grid.reshape(n_blocks, BLOCK_IDS)
    streams: list[bytes] = []
    for at in range(0, n_blocks, LANES):
        streams += encode_blocks(grid[at : at + LANES], n[at : at + LANES], freq)
    sums = np.array([zlib.crc32(grid[k, : n[k]].astype("<u4").tobytes()) for k in range(n_blocks)], "<u4")
    null = np.array([x is None for x in doc_ids], np.uint8)
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    head = zlib.compress(b"".join(x.tobytes() for x in (names, null, sizes, freq.astype("<u4"), np.array([len(x) for x in streams], "<u4"), sums)), 6)
    return MAGIC + struct.pack("<QQQQQ", len(sizes), len(flat), len(freq), n_blocks, len(head)) + head + b"".join(streams)


def unpack_file(data: bytes) -> tuple[list, list[np.ndarray]]:
    """(doc ids, ids of each document) of a file; a block whose checksum differs is an error."""
    if not data.startswith(MAGIC):
        raise ValueError("not a token file")
    n_docs, n_ids, n_used, n_blocks, n_head = struct.unpack_from("<QQQQQ", data, len(MAGIC))
    at = len(MAGIC) + 40
    head, at = zlib.decompress(data[at : at + n_head]), at + n_head
    parts, k = [], 0
    for kind, count in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", n_used), ("<u4", n_blocks), ("<u4", n_blocks)):
        parts.append(np.frombuffer(head, kind, count, k))
        k += parts[-1].nbytes
    names, null, sizes, freq, lengths, sums = parts
    ends = np.cumsum(lengths, dtype=np.int64) + at
    streams = [data[e - x : e] for e, x in zip(ends.tolist(), lengths.tolist())]
    n = np.full(n_blocks, BLOCK_IDS)
    if n_blocks:
        n[-1] = n_ids - BLOCK_IDS * (n_blocks - 1)
    flat = np.zeros(n_ids, np.uint16)
    for b in range(0, n_blocks, LANES):
        got = decode_blocks(streams[b : b + LANES], n[b : b + LANES], freq.astype(np.int64))
        for j, row in enumerate(got):
            k = b + j
            if zlib.crc32(row[: n[k]].astype("<u4").tobytes()) != sums[k]:
                raise ValueError(f"block {k} is damaged")
            flat[k * BLOCK_IDS : k * BLOCK_IDS + n[k]] = row[: n[k]]
    cuts = np.cumsum(sizes, dtype=np.int64)
    return [None if z else int(x) for x, z in zip(names, null)], np.split(flat, cuts[:-1]) if n_docs else []


# --- tokens -----------------------------------------------------------------

#: Classes of bytes of plain texts: white space, letters (those that lower-case and cut alike here and in the library), other, digits, text ends; what isn't plain.
_SPACE, _LETTER, _OTHER, _DIGIT, _END, _STRANGE = range(6)
_CLASS, _LOWER = np.full(256, _STRANGE, np.uint8), np.arange(256, dtype=np.uint8)
_CLASS[0x20:0x7F], _CLASS[list(b"\t\n\r ")], _CLASS[0] = _OTHER, _SPACE, _END
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:0xC0], _CLASS[0xC3:0xC6] = _DIGIT, _LETTER, _LETTER, _LETTER, _LETTER
_LOWER[0x41:0x5B] += 32
#: Letters up to U+017F that aren't plain (signs, and letters that fold or compose in ways of their own).
_PAIRS = (0xD7, 0xF7, 0x130, 0x149, 0x17F)
_PAIR_LOWER = np.array([ord(chr(c).lower()) if c not in _PAIRS else c for c in range(0x180)], np.int32)
#: What an apostrophe takes along as one pre-token.
_AFTER_1, _AFTER_2 = b"stmd", (b"re", b"ve", b"ll")
#: Byte-level models write a byte that is no visible character of Latin-1 as the next one of those after 255.
_VISIBLE = [x for x in range(256) if 32 < x < 127 or 160 < x and x != 173]
_BYTE_LETTERS = {x: 256 + k for k, x in enumerate(x for x in range(256) if x not in _VISIBLE)}
#: Pre-tokens that a worker keeps, and the longest of them in bytes. When the cache is full, what the texts at hand use stays.
CACHE, CACHE_BYTES = 400_000, 64


def _bounds(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow column of strings or binaries without nulls, as they lie in memory."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _binary(offsets: np.ndarray, data: np.ndarray):
    import pyarrow as pa

    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Encoder:
    """Lower-casing word-level BPE of a tokenizer file, with a bounded cache.

    Plain texts are cut into the tokenizer's own pre-tokens by array operations
    on their bytes, a batch of texts at a time. Only the distinct pre-tokens of
    a batch are looked up, only new ones reach the library, and Arrow gathers
    the ids. Texts of other characters go to the library whole.
    """

    def __init__(self, text: str):
        """``text``: what a tokenizer file holds."""
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}

    def _learn(self, word: bytes) -> bytes:
        """Ids of a pre-token, which is folded and cut already, from the library's model, as little-endian 16-bit integers."""
        letters = word.decode("latin-1")
        ids = [x.id for x in self.model.tokenize(letters if word.isascii() else letters.translate(_BYTE_LETTERS))]
        return struct.pack(f"<{len(ids)}H", *ids)

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct pre-tokens."""
        found = [self.cache.get(w) for w in words]
        new = [k for k, x in enumerate(found) if x is None]
        for k in new:
            found[k] = self._learn(words[k])
        short = [k for k in new if len(words[k]) <= CACHE_BYTES]
        if len(self.cache) + len(short) > CACHE:
            self.cache = {w: x for w, x in zip(words, found) if w in self.cache}
        self.cache.update((words[k], found[k]) for k in short[: max(0, CACHE - len(self.cache))])
        return found

    @staticmethod
    def _strange(b: np.ndarray, c: np.ndarray, ends: np.ndarray, lead: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Which texts hold what isn't plain: other characters, a NUL of their own, or the start of a special token."""
        bad = [lead[np.isin(point, _PAIRS)]]
        if c.max() == _STRANGE:
            bad.append(np.flatnonzero(c == _STRANGE))
        if b"<|" in memoryview(b).tobytes():
            bad.append(np.flatnonzero((b[:-1] == 0x3C) & (b[1:] == 0x7C)))
        nul = np.flatnonzero(b == 0)
        if len(nul) > len(ends):
            bad.append(np.setdiff1d(nul, ends, assume_unique=True))
        return np.unique(np.searchsorted(ends, np.concatenate(bad)))

    @staticmethod
    def _starts(b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: runs of letters or of other characters, single digits, text ends; an apostrophe takes some letters along."""
        start = np.ones(len(b), bool)
        start[1:] = c[1:] != c[:-1]
        start |= c >= _DIGIT
        start &= c > _SPACE
        quote = np.flatnonzero((b == 0x27) & start)
        one, two = b[quote + 1], b[np.minimum(quote + 2, len(b) - 1)]
        long = np.logical_or.reduce([(one == x) & (two == y) for x, y in _AFTER_2])
        size = np.where(np.isin(one, list(_AFTER_1)), 2, np.where(long, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + size] |= c[quote + size] > _SPACE
        return start

    def __call__(self, texts, last: int):
        """An Arrow binary array: ids of each text of an Arrow string array without nulls, then ``last``, as little-endian 16-bit integers."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return pa.array([], pa.binary())
        marked = pc.binary_join_element_wise(texts, "", "\0")
        offsets, b = _bounds(marked)
        ends, b = offsets[1:].astype(np.int64) - 1, b[: offsets[-1]]
        c = _CLASS.take(b)
        lead = np.flatnonzero(b >= 0xC3)
        point = ((b[lead].astype(np.int32) & 0x1F) << 6) | (b[lead + 1] & 0x3F)
        strange = self._strange(b, c, ends, lead, point)
        if len(strange):
            rest, at = np.ones(len(texts), bool), np.arange(len(texts))
            rest[strange], at[strange] = False, len(texts) + np.arange(len(strange))
            plain = self(pc.if_else(pa.array(rest), texts, ""), last)
            whole = self._whole(texts.take(pa.array(strange)).to_pylist(), last)
            return pa.concat_arrays([plain, pa.array(whole, pa.binary())]).take(pa.array(at))
        low, point = _LOWER.take(b), _PAIR_LOWER.take(point)
        low[lead], low[lead + 1] = 0xC0 | (point >> 6), 0x80 | (point & 0x3F)
        start, kept = self._starts(low, c), c > _SPACE
        data = low[kept]
        cuts = np.flatnonzero(start[kept])
        words = _binary(np.append(cuts, len(data)), data).dictionary_encode()
        where, data = _bounds(words.dictionary)
        whole, where = data.tobytes(), where.tolist()
        values = [whole[x:y] for x, y in zip(where, where[1:])]
        mark = values.index(b"\0")
        ids = self._look_up(values[:mark] + values[mark + 1 :])
        ids.insert(mark, struct.pack("<H", last))
        got, data = _bounds(pa.array(ids, pa.binary()).take(words.indices))
        text_end = np.flatnonzero(words.indices.to_numpy() == mark)
        return _binary(np.append(0, got[text_end + 1]), data[: got[-1]])

    def _whole(self, texts: list[str], last: int) -> list[bytes]:
        every = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)
        return [struct.pack(f"<{len(ids) + 1}H", *ids, last) for ids in every]


def _storage(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _pieces(batches, most: int):
    """(ids, texts) of Arrow batches (d, t), about ``most`` bytes of text at a time, or one row if it is longer."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "").cast(pa.string())
        sizes = np.cumsum(np.diff(_bounds(texts)[0]).astype(np.int64))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + most - size, side="right")))
            held.append((batch.column(0).slice(at, end - at), texts.slice(at, end - at)))
            size, at = size + int(sizes[end - 1] - done), end
            if size >= most or at < len(texts):
                yield pa.concat_arrays([x for x, _ in held]).to_pylist(), pa.concat_arrays([x for _, x in held])
                held, size = [], 0
    if held:
        yield pa.concat_arrays([x for x, _ in held]).to_pylist(), pa.concat_arrays([x for _, x in held])


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, last: int = 1, doc_id: str = "doc_id", text: str = "text", file_chars: int = FILE_CHARS) -> DataFrame:
    """Token files of all texts in ascending doc_id order; returns the manifest (file, path, n_ids, start), ``start`` being the ids before it.

    Texts are dealt by ranges of ids and sorted inside each, and a task cuts
    its range into files of about ``file_chars`` bytes of text as it goes, so it
    holds one file's ids at a time, however many rows share an id or have a
    null one. Each text is followed by the id ``last``. A null text is empty;
    null ids come first; rows that repeat a doc_id stand side by side, ordered
    by a hash of their texts. An empty table gives no files, extra columns are
    ignored. Files of a lost task attempt aren't in the manifest.
    ``tokenizer_path`` is read by the driver and its bytes go along with the
    tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chars = docs.agg(F.sum(F.length(text)), F.count(F.lit(1))).first()
    ranges = max(1, -(-int((chars[0] or 0) + (chars[1] or 0)) // file_chars))
    with open(tokenizer_path, "rb") as f:
        model = spark.sparkContext.broadcast(zlib.compress(f.read(), 6))

    def work(batches):
        import sys

        import pyarrow as pa
        from pyspark import TaskContext

        # A worker serves many tasks; the encoder, with its cache, stays with it.
        held = sys.modules.setdefault("_cellweave_encoders", type(sys)("_cellweave_encoders")).__dict__
        if tokenizer_path not in held:
            held[tokenizer_path] = Encoder(zlib.decompress(model.value).decode())
        enc = held[tokenizer_path]
        fs, top = _storage(folder)
        fs.create_dir(top, recursive=True)
        part, made = TaskContext.get().partitionId(), 0
        names, sizes, ids, size = [], [], [], 0

        def write():
            nonlocal made, size
            data = pack_flat(names, np.concatenate(sizes), np.concatenate(ids))
            path = f"{top}/{part:08d}-{made:06d}-{uuid.uuid4().hex}.cwt"
            with fs.open_output_stream(path) as f:
                f.write(data)
            row = pa.RecordBatch.from_pydict({"part": [part], "nth": [made], "path": [path], "n_ids": [sum(map(len, ids))]}, schema=schema)
            made, size = made + 1, 0
            for x in (names, sizes, ids):
                x.clear()
            return row

        for who, texts in _pieces(batches, min(BATCH_BYTES, file_chars)):
            offsets, data = _bounds(enc(texts, last))
            names += who
            sizes.append(np.diff(offsets) // 2)
            ids.append(data[: offsets[-1]].view("<u2"))
            size += int(_bounds(texts)[0][-1] - _bounds(texts)[0][0]) + len(who)
            if size >= file_chars:
                yield write()
        if names:
            yield write()
        release()

    schema = to_arrow_schema(StructType.fromDDL("part int, nth int, path string, n_ids long"))
    # Ids and a hash make the ranges; both are cheap to sample, and no text is.
    narrow = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    dealt = narrow.repartitionByRange(ranges, "d", "h").sortWithinPartitions("d", "h").select("d", "t")
    made = materialize(dealt.mapInArrow(work, "part int, nth int, path string, n_ids long"), "token-manifest")
    # A row for each file, of some million ids: the running sum is the driver's.
    listed = made.orderBy("part", "nth").toPandas()
    listed["start"] = (listed["n_ids"].cumsum() - listed["n_ids"]).astype("int64")
    listed["file"] = np.arange(len(listed), dtype=np.int32)
    return spark.createDataFrame(listed[["file", "path", "n_ids", "start"]], "file int, path string, n_ids long, start long")


def read_tokens(manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) read back from the files; without ``ids`` that column is left out."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def read(batches):
        fs, _ = _storage(folder)
        for b in batches:
            for path, start in zip(b["path"], b["start"]):
                with fs.open_input_file(path) as f:
                    names, docs = unpack_file(f.read())
                n = np.array([len(x) for x in docs], np.int64)
                out = pd.DataFrame({"doc_id": pd.array(names, "Int64"), "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in docs]})
                if ids:
                    out["ids"] = [x.astype(np.int32) for x in docs]
                yield out

    return manifest.repartition(max(1, manifest.count()), "file").select("path", "start").mapInPandas(read, schema)


def op4_token_files(spark, sf_dir, tokenizer_path: str | None = None):
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    folder = fresh_path(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path)
    return read_tokens(manifest, folder, ids=False)
