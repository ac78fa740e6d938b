"""Token ids of whole texts by a tokenizer file of the tokenizers library, with a memo of frequent units.

A byte-level BPE tokenizer splits a text into pieces before it merges. A single space between two characters that are
not white space always begins a piece, and a single line end between them is a piece of its own. A batch of texts is
therefore cut there, its distinct units are looked up once, new ones are encoded by the library and remembered up to a
bounded number, and the ids are put together by array operations. They equal those of encoding each whole text in one
call; texts with any other white space between words, or with the string of an added token in them, are encoded that way.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np

#: Units remembered per worker process (some 50 MB) and new units encoded in one call.
MEMO_UNITS, TOGETHER = 1_000_000, 1000
#: A remembered unit has at most this many bytes: three words of eight bytes hold it whole, with its length and kind.
MEMO_BYTES = 23


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _odd(unit: str) -> bool:
    word = unit[1:] if unit[:1] == "\n" else unit
    return not word or word[0].isspace() or word[-1].isspace()


def _strings(units) -> list[str]:
    """An Arrow array of strings without spaces as a list: joined, read once and cut again."""
    import pyarrow as pa
    import pyarrow.compute as pc

    whole = pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units.cast(pa.string()))
    return pc.binary_join(whole, " ")[0].as_py().split(" ") if len(units) else []


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _keys(units) -> tuple[np.ndarray, np.ndarray]:
    """(n by 3 words, whether the unit fits) of an Arrow array of large strings: the bytes themselves and the length."""
    offsets = np.frombuffer(units.buffers()[1], dtype=np.int64)[units.offset : units.offset + len(units) + 1]
    data = units.buffers()[2]
    raw = np.concatenate([np.frombuffer(data, dtype=np.uint8)[: offsets[-1]] if data else np.empty(0, np.uint8), np.zeros(32, np.uint8)])
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))  # the eight bytes from every place on
    size = np.diff(offsets)
    fits = size <= MEMO_BYTES
    keys = np.empty((len(size), 3), dtype=np.uint64)
    for k in range(3):
        keys[:, k] = eight[np.minimum(offsets[:-1] + 8 * k, len(raw) - 8)] & _MASKS[np.clip(size - 8 * k, 0, 8)]
    keys[fits, 2] |= size[fits].astype(np.uint64) << np.uint64(56)
    return keys, fits


class _Table:
    """Rows by key: open addressing over arrays, looked up and filled many keys at a time."""

    def __init__(self, most: int) -> None:
        self.slots = np.full(1 << (2 * most - 1).bit_length(), -1, dtype=np.int32)
        self.keys = np.empty((most + most // 4 + 1, 3), dtype=np.uint64)  # touched only as it fills

    def _start(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (keys[:, 2] * np.uint64(0x165667B19E3779F9))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(30)).astype(np.int64) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        rows = np.full(len(keys), -1, dtype=np.int64)
        at, open_ = self._start(keys), np.arange(len(keys))
        while len(open_):
            there = self.slots[at[open_]]
            taken = there >= 0
            open_, there = open_[taken], there[taken]
            same = (self.keys[there] == keys[open_]).all(1)
            rows[open_[same]] = there[same]
            open_ = open_[~same]
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
        return rows

    def put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Add keys that are distinct and not there yet."""
        if len(rows) and rows.max() >= len(self.keys):
            more = np.empty((max(2 * len(self.keys), int(rows.max()) + 1), 3), dtype=np.uint64)
            more[: len(self.keys)] = self.keys
            self.keys = more
        self.keys[rows] = keys
        at, open_ = self._start(keys), np.arange(len(keys))
        while len(open_):
            free = self.slots[at[open_]] < 0
            self.slots[at[open_[free]]] = rows[open_[free]]
            open_ = open_[self.slots[at[open_]] != rows[open_]]
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)


#: The kind of a unit that begins a text, beside its length in a key; units after a line end begin with it.
_FIRST = np.uint64(1 << 62)


class Encoder:
    """Encodes whole texts as the library's encode(text, add_special_tokens=False) does, strings of added tokens included.

    ``table`` gives a unit's row, ``start`` and ``size`` where its ids lie in ``flat``. A unit stands for a space and the
    word, for a line end and the word, or for the word that begins a text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content)
        self.table = _Table(MEMO_UNITS)
        self.count, self.used = 0, 0
        self.flat = np.empty(6 * MEMO_UNITS + 1, dtype="<u4")  # these too are touched only as they fill
        self.start, self.size, self.odd = (np.empty(MEMO_UNITS + MEMO_UNITS // 4 + 1, kind) for kind in (np.int32, np.int32, bool))
        self.line_end = self.ids("\n")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of forms without line ends inside; line ends between them are tokens of their own."""
        ids, sizes = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for i in range(0, len(forms), TOGETHER):
            part = forms[i : i + TOGETHER]
            got = self.ids("\n".join(part)) if len(self.line_end) == 1 else self.line_end
            stop = got == self.line_end[0]
            stops = np.flatnonzero(stop)
            if len(stops) == len(part) - 1:
                ids.append(got[~stop])
                sizes.append(np.diff(np.concatenate([[-1], stops, [len(got)]])) - 1)
            else:
                each = [self.ids(f) for f in part]
                ids += each
                sizes.append(np.array([len(x) for x in each], dtype=np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _add(self, ids: np.ndarray, sizes: np.ndarray, odd: bool = False) -> None:
        n, more = self.count, len(sizes)
        if n + more > len(self.start):
            grow = max(2 * len(self.start), n + more)
            self.start, self.size, self.odd = (np.resize(x, grow) for x in (self.start, self.size, self.odd))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[n : n + more], self.odd[n : n + more] = sizes, odd
        self.start[n : n + more] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.count += more

    def _find(self, units, keys: np.ndarray, fits: np.ndarray, first: bool, fresh: list) -> np.ndarray:
        """The rows of distinct units; new ones are added, and noted in fresh to be remembered."""
        found = np.full(len(units), -1, dtype=np.int64)
        found[fits] = self.table.find(keys[fits])
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found
        names = _strings(units.take(new))
        groups: tuple[list, ...] = ([], [], [], [])  # after a space, after a line end, first of a text, odd
        for i, unit in enumerate(names):
            groups[3 if _odd(unit) else 1 if unit[0] == "\n" else 2 if first else 0].append(i)
        for kind, own in enumerate(groups):
            if own:
                place = new[own]
                found[place] = self.count + np.arange(len(own))
                if kind == 3:
                    self._add(np.empty(0, "<u4"), np.zeros(len(own), np.int64), True)
                else:
                    ids, sizes = self._learn([names[i][kind == 1 :] for i in own] if kind else [" " + names[i] for i in own])
                    if kind == 1:
                        ids, sizes = np.insert(ids, np.repeat(np.cumsum(sizes) - sizes, len(self.line_end)), np.tile(self.line_end, len(own))), sizes + len(self.line_end)
                    self._add(ids, sizes)
                kept = place[fits[place]]
                fresh.append((keys[kept], found[kept]))
        return found

    def encode_batch(self, column, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of an Arrow string column, each text followed by end_id if given.

        A null text counts as empty.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column.cast(pa.large_string()), "")
        n, tail = len(column), int(end_id is not None)
        split = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        at = split.offsets.to_numpy()
        coded = split.values.slice(int(at[0]), int(at[-1] - at[0])).dictionary_encode()
        at = at - at[0]
        codes, units = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        begun, fresh = (self.count, self.used), []
        keys, fits = _keys(units)
        rows = self._find(units, keys, fits, False, fresh)
        row = rows[codes]
        if n:
            which, back = np.unique(codes[at[:-1]], return_inverse=True)  # distinct units that begin a text
            own, own_fits = keys[which], fits[which]
            own[own_fits & (own[:, 0] & np.uint64(255) != 10), 2] |= _FIRST
            row[at[:-1]] = self._find(units.take(pa.array(which)), own, own_fits, True, fresh)[back]
        size = self.size[row]
        counts = np.add.reduceat(size, at[:-1], dtype=np.int64) if n else np.empty(0, np.int64)
        odd = np.unique(np.searchsorted(at, np.flatnonzero(self.odd[row]), side="right") - 1)
        for content in self.added:
            odd = np.union1d(odd, np.flatnonzero(pc.match_substring(column, content).to_numpy(zero_copy_only=False)))
        total = int(size.sum())
        kind = np.int32 if max(total, self.used) < 1 << 31 else np.int64
        at_ids = np.repeat((self.start[row] - (np.cumsum(size, dtype=np.int64) - size)).astype(kind), size)
        at_ids += np.arange(total, dtype=kind)
        ids = self.flat[at_ids]
        if len(odd):
            bounds, whole = np.concatenate([[0], np.cumsum(counts)]), {i: self.ids(column[i].as_py()) for i in odd.tolist()}
            ids = np.concatenate([whole[i] if i in whole else ids[bounds[i] : bounds[i + 1]] for i in range(n)])
            counts = np.array([len(whole[i]) if i in whole else counts[i] for i in range(n)], dtype=np.int64)
        if self.count <= MEMO_UNITS:
            for new, rows_of in fresh:
                self.table.put(new, rows_of)
        else:
            self.count, self.used = begun  # this batch's new units are forgotten
        if tail:
            out = np.full(len(ids) + n, end_id, dtype="<u4")
            own = np.ones(len(out), dtype=bool)
            own[np.cumsum(counts + 1) - 1] = False
            out[own] = ids
            return out, counts + 1
        return ids, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per path and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def sentence_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: whether the token can end a sentence or line, and whether it begins with a space or line end."""
    vocabulary = encoder(path).tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    starts = ends.copy()
    for piece, i in vocabulary.items():  # Ġ and Ċ stand for space and line end in byte-level vocabularies
        ends[i] = any(c in ".!?Ċ" for c in piece)
        starts[i] = piece[:1] in ("Ġ", "Ċ")
    return ends, starts
