"""Whole-text token ids by the tokenizers library, through a cache of stretches bounded in bytes.

Both public vocabularies cut a text at white space before they merge, so the ids
of a text are the ids of its stretches one after another. A stretch that occurs
again is looked up; new ones are encoded by the library, many in one call. Both cut
between letters and marks too, so a new word with marks behind it is the word and the marks.
A text whose white space does not follow the simple pattern, or that holds the
string of an added token, goes through the library whole, so the ids always equal
those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
With ``special_as_text`` the strings of special tokens in a text are ordinary text
(the library's ``encode_special_tokens``).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

CACHE_BYTES = 128 * 1024 * 1024  # of stretches learnt; those of the round before stay beside them
LONGEST_KEPT = 256  # characters of a stretch that outlives its batch
_ENTRY_BYTES = 200  # of a stretch besides its own characters and ids
_PART_CHARS = 4_000_000  # characters cut into stretches at once
_JOIN = 400
# letters, then ASCII marks; an apostrophe may begin a contraction, which is not cut there
_WORD_MARKS = re.compile("(\0?[^\\W\\d_]+)([!-&(-/:-@\\[-`{-~]+)")
# white space other than blanks and line feeds, and the mark of a first stretch
_ODD = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\0"
_ODD_WIDE = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# beyond these letters lower-casing may depend on neighbours or on the version of Unicode
_BEYOND_LATIN = re.compile("[^\0-\u024f]")
_INSTANCES: dict[tuple[str, bool], "CachedEncoder"] = {}


def encoder(path: str, special_as_text: bool = False) -> "CachedEncoder":
    """One encoder per worker process, vocabulary file and reading of special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    key = path, special_as_text
    if key not in _INSTANCES:
        _INSTANCES[key] = CachedEncoder(path, special_as_text)
    return _INSTANCES[key]


class CachedEncoder:
    def __init__(self, path: str, special_as_text: bool = False):
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = special_as_text
        added = [t for t in self.lib.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = [t.content for t in added]
        # a normalized token is matched in the normalized text
        self.added_normal = [self._normal(t.content) for t in added if t.normalized]
        # a word-end vocabulary drops white space; a byte-level one keeps it in its ids
        self.drops_space = self.lib.encode("a b", add_special_tokens=False).ids == [
            *self.lib.encode("a", add_special_tokens=False).ids,
            *self.lib.encode("b", add_special_tokens=False).ids,
        ]
        # characters that every normalized added token holds; no other character is lower-cased or composed to one of these
        self.marks = [c for c in "<|>" if all(c in x for x in self.added_normal)]
        self.lowers = self.lib.encode("ÀB", add_special_tokens=False).ids == self.lib.encode("àb", add_special_tokens=False).ids
        self.cuts_marks = all(len(self.lib.pre_tokenizer.pre_tokenize_str(x)) == 2 for x in ("ab&.", "é_-"))
        self.bare = self._without_normalizer()
        self.sizes = self._token_bytes()
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.weight = 0

    def _normal(self, text: str) -> str:
        return self.lib.normalizer.normalize_str(text) if self.lib.normalizer else text

    def _without_normalizer(self) -> Tokenizer:
        """The same vocabulary for words that the normalizer leaves as they are."""
        if self.lib.normalizer is None:
            return self.lib
        return Tokenizer.from_str(json.dumps(json.loads(self.lib.to_str()) | {"normalizer": None}))

    def _token_bytes(self) -> np.ndarray:
        """Bytes of text that each id stands for (a byte-level vocabulary has one character a byte)."""
        suffix = getattr(self.lib.model, "end_of_word_suffix", None) or ""
        sizes = np.zeros(self.lib.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            sizes[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        return sizes

    def _plain(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _stretches(self, text: str) -> list[str] | None:
        """Stretches whose ids are independent; None if the text needs the library as a whole."""
        if any(x in text for x in self.added):
            return None
        if self.added_normal and all(c in text for c in self.marks):
            shown = self._normal(text)
            if any(x in shown for x in self.added_normal):
                return None
        if self.drops_space:
            if self.lowers and (text.isascii() or not _BEYOND_LATIN.search(text)):
                low = text.lower()  # one stretch for both cases
                if not any(x in low for x in self.added):
                    text = low
            return text.replace("\n", " ").split(" ")
        if any(x in text for x in _ODD):
            return None
        if not text.isascii() and _ODD_WIDE.search(text):
            return None
        # two kinds of white space in a row leave "" or a lone line feed, which the cache never holds
        out = text.replace("\n", " \n").split(" ")
        out[0] = "\0" + out[0]  # the first stretch has no blank before it
        return out

    def _learn(self, new: list[str]) -> None:
        """Encode stretches not seen before, many joined in one call, and cut the ids by their bytes."""
        joinable, plain, before = new, [], ""
        if not self.drops_space:
            joinable = [w for w in new if w[0] not in "\0\n"]
            plain, before = [w for w in new if w[0] in "\0\n"], " "
        # letters up to Latin Extended-B in lower case are composed and stay as they are
        normal = [w for w in joinable if w.isalpha() and w.islower() and not _BEYOND_LATIN.search(w)]
        if len(normal) < len(joinable):
            known = set(normal)
            plain += self._learn_joined(self.lib, [w for w in joinable if w not in known], before)
        plain += self._learn_joined(self.bare, normal, before)
        if plain:
            texts = [w[1:] if w[0] == "\0" else w if self.drops_space or w[0] == "\n" else " " + w for w in plain]
            for w, e in zip(plain, self.lib.encode_batch_fast(texts, add_special_tokens=False)):
                self._keep(w, np.array(e.ids, dtype="<u4").tobytes())

    def _learn_joined(self, lib: Tokenizer, words: list[str], before: str) -> list[str]:
        """Learn words many in one call; returns those whose ids can't be told apart there (the library changed lengths: rare characters)."""
        left = []
        for lo in range(0, len(words), _JOIN * 64):
            groups = [words[i : i + _JOIN] for i in range(lo, min(lo + _JOIN * 64, len(words)), _JOIN)]
            joined = [before + " ".join(g) for g in groups]
            for group, text, e in zip(groups, joined, lib.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                ends = np.cumsum(self.sizes[ids])
                cut, want = None, self._ends(text, len(group))
                if want is not None and len(ends) and ends[-1] == want[-1]:
                    cut = np.searchsorted(ends, want) + 1
                if cut is not None and np.array_equal(ends[cut - 1], want):
                    raw = ids.tobytes()
                    stops = (cut * 4).tolist()
                    self.cache.update(zip(group, [raw[x:y] for x, y in zip([0, *stops], stops)]))
                    self.weight += len(group) * _ENTRY_BYTES + len(text) + len(raw)
                else:
                    left += group
        return left

    def _keep(self, word: str, ids: bytes) -> None:
        self.cache[word] = ids
        self.weight += _ENTRY_BYTES + len(word) + len(ids)

    def _ends(self, joined: str, n: int) -> np.ndarray | None:
        """Where the ids of each of ``n`` joined words end, in bytes that ids stand for."""
        if self.drops_space:
            joined = unicodedata.normalize("NFC", joined).lower()
        raw = np.frombuffer(joined.encode(), dtype=np.uint8)
        blanks = np.flatnonzero(raw == 0x20)
        if self.drops_space:
            return np.append(blanks, len(raw)) - np.arange(n) if len(blanks) == n - 1 else None
        return np.append(blanks[1:], len(raw)) if len(blanks) == n else None

    def _round(self) -> None:
        """Begin a new round of the cache when this one is full; stretches of the last round come back when they are met again."""
        if self.weight > CACHE_BYTES:
            self.old = {w: x for w, x in self.cache.items() if len(w) <= LONGEST_KEPT}
            self.cache, self.weight = {}, 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers (null: none)."""
        out, lo, size = [], 0, 0
        for hi, t in enumerate(texts, 1):
            size += len(t or "")
            if size > _PART_CHARS or hi == len(texts):
                out += self._encoded(texts[lo:hi])
                lo, size = hi, 0
        return out

    def _encoded(self, texts: list[str | None]) -> list[bytes]:
        self._round()
        cut = [self._stretches(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(words for words in cut if words))
        ids = list(map(self.cache.get, flat))
        missing = {w for w, x in zip(flat, ids) if x is None}
        if missing:
            self._fetch(missing)
            get = self.cache.get
            ids = [get(w) if x is None else x for w, x in zip(flat, ids)]
        out, at = [], 0
        for t, words in zip(texts, cut):
            own = ids[at : at + len(words or ())]
            at += len(own)
            # two kinds of white space in a row leave a stretch that is never learnt: the text goes through the library
            out.append(self._plain(t) if words is None or None in own else b"".join(own))
        return out

    def _fetch(self, missing: set[str]) -> None:
        if self.drops_space:
            self.cache[""] = b""
        else:
            missing.discard("\n")
        missing.discard("")
        new, pairs = set(), []
        for w in missing:
            x = self.old.get(w)
            if x is not None:
                self._keep(w, x)
            elif self.cuts_marks and (m := _WORD_MARKS.fullmatch(w)):
                # marks after a word have no blank before them
                pairs.append((w, m[1], m[2] if self.drops_space else "\0" + m[2]))
            else:
                new.add(w)
        for part in {part for _, *parts in pairs for part in parts}.difference(self.cache, new):
            x = self.old.get(part)
            if x is not None:
                self._keep(part, x)
            else:
                new.add(part)
        if new:
            self._learn(list(new))
        for w, word, marks in pairs:
            self._keep(w, self.cache[word] + self.cache[marks])
