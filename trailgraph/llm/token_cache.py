"""Token ids of whole texts, each distinct word encoded once per worker.

A tokenizer never joins what stands before a blank with what stands after it,
so a text may be cut in front of single blanks without changing its ids.  The
words of a slice of texts are found and made distinct by comparing bytes; the
ids of those met before lie in sorted numpy arrays, known by two hashes, and the
ids of a slice are gathered at once.  Texts whose cuts are not safe (runs of
white space that a blank ends, control characters, strings of special tokens)
are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trailgraph.llm.common import by_size
from trailgraph.llm.words import byte_class, hashes_of, words_of

#: Words kept by a worker; when there are more, those met but once go.
KEPT_WORDS = 1_500_000
#: Bytes of text whose words are looked up together.
STEP_BYTES = 4 << 20

_UNSAFE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
_BLANK = byte_class(b" ")
# Marks that no tokenizer here joins with letters before them.
_MARKS = ".,!?;:$%&*#"
_SPACE = re.compile(r"\s")
_PARTS = re.compile(r"\s*\S+")
# Composed Latin letters whose lower case is one letter each.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+"
_PLAIN_ALONE, _PLAIN_MARKED = _PLAIN + "$", _PLAIN + f"[{_MARKS}]*$"
#: Words of letters that are encoded at once.
TOGETHER = 2_000
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of this worker for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _lettered(word: str) -> bool:
    """Whether a word is of letters alone, composed and in lower case too."""
    return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())


def _matches(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)


class Plain:
    """Encodes words of Latin letters, a blank before each, many at a time.

    Normalizing takes most of a tokenizer's time and does nothing to composed
    lower-case letters and single blanks.  So one that would not normalize gets
    the words in lower case, and its ids are cut where words end or begin.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer.to_str())
        normalizer = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
        steps = normalizer.get("normalizers", [normalizer])
        blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        splits = spec["pre_tokenizer"] or {"type": ""}
        splits = [split["type"] for split in splits.get("pretokenizers", [splits])]
        self.lower = {"type": "Lowercase"} in steps
        self.suffix = spec["model"].get("end_of_word_suffix")
        #: Whether no step does anything else, and ids tell where words end or begin.
        self.usable = (
            all(step in ({"type": "NFC"}, {"type": "Lowercase"}, blanks) for step in steps)
            and splits[-1] == "ByteLevel" and spec["model"]["type"] == "BPE"
        )
        if self.usable:
            self.tokenizer = Tokenizer.from_str(json.dumps({**spec, "normalizer": None}))
            self.edge = np.zeros(tokenizer.get_vocab_size(), bool)
            for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
                self.edge[number] = token.endswith(self.suffix) if self.suffix else token.startswith("\u0120")

    def encode(self, words: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """Of each run of words: the first, the one after the last, the ids, and how
        many each word has, or none if that can't be told."""
        bounds = np.append(np.arange(0, len(words), TOGETHER), len(words))
        runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pc.utf8_lower(words) if self.lower else words)
        texts = [" " + text for text in pc.binary_join(runs, " ").to_pylist()]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        for first, after, encoding in zip(bounds[:-1].tolist(), bounds[1:].tolist(), encoded):
            ids = np.array(encoding.ids, np.uint32)
            edges = np.flatnonzero(self.edge[ids])
            if self.suffix:
                told, sizes = edges[-1:] == len(ids) - 1, np.diff(edges, prepend=-1)
            else:
                told, sizes = edges[:1] == 0, np.diff(edges, append=len(ids))
            yield first, after, ids, sizes if told.all() and len(edges) == after - first else None


class Known:
    """Ids of words by two hashes.  A size of -1 says that the word must not be cut off."""

    def __init__(self):
        empty = [np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.int64, np.int32, bool)]
        self.tiers = [empty, empty]
        self.ids = np.zeros(1024, np.uint32)
        self.used = 0

    @staticmethod
    def _tier(columns: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(columns[0], kind="stable")
        return [column[order] for column in columns]

    def __len__(self) -> int:
        return sum(len(tier[0]) for tier in self.tiers)

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are known, where their ids start, and how many they are."""
        known = np.zeros(len(one), bool)
        starts, sizes = np.zeros(len(one), np.int64), np.zeros(len(one), np.int32)
        for first, second, start, size, met in self.tiers:
            if len(first):
                at = np.minimum(np.searchsorted(first, one), len(first) - 1)
                here = (first[at] == one) & (second[at] == two)
                known |= here
                starts[here], sizes[here] = start[at[here]], size[at[here]]
                met[at[here]] = True
        return known, starts, sizes

    def put(self, ids: np.ndarray) -> int:
        """Lay ids down behind the others, and say where."""
        start, self.used = self.used, self.used + len(ids)
        while self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[start : self.used] = ids
        return start

    def gathered(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids that start at ``starts``, one after another."""
        sizes = np.maximum(sizes, 0).astype(np.int64)
        upto = np.cumsum(sizes)
        return self.ids[np.repeat(starts - (upto - sizes), sizes) + np.arange(int(sizes.sum()))]

    def add(self, one: np.ndarray, two: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Keep words that are not known, whose ids are laid down."""
        old, new = self.tiers
        columns = one, two, starts, sizes.astype(np.int32), np.zeros(len(one), bool)
        new = self._tier([np.concatenate(pair) for pair in zip(new, columns)])
        if 4 * len(new[0]) > len(old[0]):
            old, new = self._tier([np.concatenate(pair) for pair in zip(old, new)]), [c[:0] for c in new]
        self.tiers = [old, new]

    def met_again(self, most: int) -> "Known":
        """Those that were met again, with their ids, if they are no more than ``most``."""
        *columns, met = (np.concatenate(pair) for pair in zip(*self.tiers))
        one, two, starts, sizes = (column[met] for column in columns)
        kept = Known()
        if len(one) <= most:
            held = np.maximum(sizes, 0).astype(np.int64)
            kept.add(one, two, kept.put(self.gathered(starts, sizes)) + np.cumsum(held) - held, sizes)
        return kept


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.plain = Plain(self.tokenizer)
        self.known = Known()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        found: list[bytes] = []
        for part in by_size(texts, STEP_BYTES):
            found.extend(self._step(part))
        return found

    def _step(self, texts: list[str | None]) -> list[bytes]:
        safe = np.array([bool(t) and not any(mark in t for mark in _UNSAFE) for t in texts], bool)
        kept = pa.array([t if s else None for t, s in zip(texts, safe)], pa.large_string())
        words = words_of(kept, _BLANK, lower=False)
        counts = np.bincount(words.row, minlength=len(texts))
        blanks = np.array([t.count(" ") if s else 0 for t, s in zip(texts, safe)])
        safe &= counts == blanks + 1  # no blanks at the ends, and none beside another
        starts, sizes = self._of_words(words.distinct)
        first = (np.cumsum(counts) - counts)[safe]
        code = words.code.astype(np.int64)
        heads = words.distinct.take(pa.array(words.code[first])).to_pylist()
        code[first] = len(starts) + np.arange(len(heads))
        begin, held = self._of_heads(heads)
        starts, sizes = np.concatenate([starts, begin]), np.concatenate([sizes, held])
        each = sizes[code]
        never = np.zeros(len(texts), bool)
        never[words.row[each < 0]] = True
        ids = self.known.gathered(starts[code], each)
        upto = np.concatenate([[0], np.cumsum(np.maximum(each, 0))])
        edges = upto[np.concatenate([[0], np.cumsum(counts)])].tolist()
        found = []
        for number, text in enumerate(texts):
            if not text:
                found.append(b"")
            elif safe[number] and not never[number]:
                found.append(ids[edges[number] : edges[number + 1]].tobytes())
            else:
                found.append(self._whole(text))
        return found

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words that follow a blank start, and how many they are."""
        if len(self.known) > KEPT_WORDS:
            self.known = self.known.met_again(KEPT_WORDS // 2)
        one, two = hashes_of(words), hashes_of(words, 1)
        known, starts, sizes = self.known.find(one, two)
        new = np.flatnonzero(~known)
        if len(new):
            starts[new], sizes[new] = self._learned(words.take(pa.array(new)))
            self.known.add(one[new], two[new], starts[new], sizes[new])
        return starts, sizes

    def _learned(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new words start, and how many; a word that ends in white space must not be cut off.

        What stands between blanks may hold other white space, such as line
        ends.  It is cut in front of that, and the parts behind are kept as well.
        """
        first, behind, owner = [], [], []
        plain = _matches(words, _PLAIN_MARKED)
        odd = np.flatnonzero(~plain)
        for number, word in zip(odd.tolist(), words.take(pa.array(odd)).to_pylist()):
            if _SPACE.search(word) and not word[-1].isspace():
                one, *more = _PARTS.findall(word)
                first.append(one)
                behind.extend(more)
                owner.extend([number] * len(more))
            else:
                first.append(word)
        begin, held = self._blank_before(
            pa.concat_arrays([words.filter(pa.array(plain)), pa.array(first, pa.string())])
        )
        place = np.argsort(np.concatenate([np.flatnonzero(plain), odd]))
        starts, sizes = begin[place], held[place]
        if behind:
            begin, held = self._inside(behind)
            several = np.unique(owner)
            order = np.argsort(np.concatenate([several, owner]), kind="stable")
            units = np.concatenate([sizes[several], held])[order]
            flat = self.known.gathered(np.concatenate([starts[several], begin])[order], units)
            whole = np.bincount(np.concatenate([several, owner]).astype(np.int64)[order], units)[several].astype(np.int64)
            starts[several] = self.known.put(flat) + np.cumsum(whole) - whole
            sizes[several] = whole
        return starts, sizes

    def _inside(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts that start with white space and follow none."""
        distinct = pa.array(parts, pa.string()).dictionary_encode()
        one, two = hashes_of(distinct.dictionary, 2), hashes_of(distinct.dictionary, 3)
        known, starts, sizes = self.known.find(one, two)
        new = np.flatnonzero(~known)
        if len(new):
            starts[new], sizes[new] = self._one_by_one(distinct.dictionary.take(pa.array(new)).to_pylist())
            self.known.add(one[new], two[new], starts[new], sizes[new])
        place = distinct.indices.to_numpy()
        return starts[place], sizes[place].astype(np.int64)

    def _blank_before(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without other white space.

        Marks behind letters are a word of their own to the tokenizer, so the
        letters are looked up, or encoded, without them.
        """
        plain = _matches(words, _PLAIN_MARKED)
        odd = np.flatnonzero(~plain)
        others = words.take(pa.array(odd)).to_pylist()
        letters = [w.rstrip(_MARKS) for w in others]
        letters = [one if _lettered(one) else w for one, w in zip(letters, others)]
        order = pa.array(np.argsort(np.concatenate([np.flatnonzero(plain), odd])))
        cut = pc.utf8_rtrim(words.filter(pa.array(plain)), _MARKS)
        distinct = pa.concat_arrays([cut, pa.array(letters, pa.string())]).take(order).dictionary_encode()
        bases, place = distinct.dictionary, distinct.indices.to_numpy()
        one, two = hashes_of(bases), hashes_of(bases, 1)
        known, starts, sizes = self.known.find(one, two)
        new = np.flatnonzero(~known)
        if len(new):
            starts[new], sizes[new] = self._encoded(bases.take(pa.array(new)))
        marked = pc.not_equal(pc.binary_length(words), pc.binary_length(bases.take(distinct.indices)))
        marked = marked.to_numpy(zero_copy_only=False)
        # letters without their marks are known from now on, if they are not among the words themselves
        alone = np.zeros(len(bases), bool)
        alone[place[~marked]] = True
        extra = np.flatnonzero(~known & ~alone)
        self.known.add(one[extra], two[extra], starts[extra], sizes[extra])
        begin, held = starts[place], sizes[place].astype(np.int64)
        here = np.flatnonzero(marked)
        if len(here):
            behind = pc.replace_substring_regex(words.take(pa.array(here)), f"^.*[^{_MARKS}]", "").dictionary_encode()
            where, many = self._one_by_one(behind.dictionary.to_pylist())
            where, many = where[behind.indices.to_numpy()], many[behind.indices.to_numpy()]
            flat = self.known.gathered(
                np.column_stack([begin[here], where]).ravel(), np.column_stack([held[here], many]).ravel()
            )
            held[here] += many
            begin[here] = self.known.put(flat) + np.cumsum(held[here]) - held[here]
        return begin, held

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words, encoded.  Words of letters alone go many at a time,
        since the tokenizer tells which of its own words an id belongs to."""
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = _matches(words, _PLAIN_ALONE) if self.plain.usable else np.zeros(len(words), bool)
        places, others = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        for first, after, ids, size in self.plain.encode(words.filter(pa.array(plain))) if len(places) else ():
            part = places[first:after]
            if size is None:
                others.append(part)
                continue
            starts[part] = self.known.put(ids) + np.cumsum(size) - size
            sizes[part] = size
        others = np.concatenate(others)
        words = dict(zip(others.tolist(), words.take(pa.array(others)).to_pylist()))
        alone = {n: _lettered(w) for n, w in words.items()}
        lettered = [n for n, yes in alone.items() if yes]
        rest = [n for n, yes in alone.items() if not yes]
        parts = [lettered[at : at + TOGETHER] for at in range(0, len(lettered), TOGETHER)]
        texts = [" " + " ".join([words[n] for n in part]) for part in parts]
        for part, encoding in zip(parts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            own = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
            if own[0] != 0 or own[-1] != len(part) - 1 or not np.isin(np.diff(own), (0, 1)).all():
                rest.extend(part)
                continue
            size = np.bincount(own)
            starts[part] = self.known.put(np.array(encoding.ids, np.uint32)) + np.cumsum(size) - size
            sizes[part] = size
        starts[rest], sizes[rest] = self._one_by_one([" " + words[n] for n in rest])
        return starts, sizes

    def _of_heads(self, heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for the first words of texts, which are not kept: the next words overwrite them."""
        used = self.known.used
        found = self._one_by_one(heads)
        self.known.used = used
        return found

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [encoding.ids for encoding in encoded]
        size = np.array([len(i) for i in ids], np.int64)
        start = self.known.put(np.fromiter(chain.from_iterable(ids), np.uint32)) + np.cumsum(size) - size
        return start, np.where([w[-1].isspace() for w in words], -1, size)
