"""Text to ids with the tokenizers library, words remembered between texts.

Both public BPE files cut a text into pre-tokens before any merge, so the ids of
a text are the ids of its pieces put together when it is cut where a pre-token
must end.  Pieces repeat far more often than texts: a slice of texts is cut and
its distinct pieces are found by Arrow, each is encoded by the library once and
remembered in a bounded cache, and numpy puts the ids of the texts together.  A
tokenizer of another kind is used on whole texts.

Strings of added tokens (``<|endoftext|>``) are what the library makes of them:
by default one id; with ``special_as_text`` ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Remembered pieces per generation; two generations are kept.
CACHE = 500_000
#: Longest piece that is remembered.
LONGEST = 64
#: Characters of a text that are cut at a time, and of texts that are looked up together.
PART = 1 << 20
GROUP = 2 << 20

# Cuts that no pre-token of the byte-level pattern crosses: before a single
# space or line end between two non-spaces, and after such a line end.
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: All white space (of Python, which has more of it than the tokenizers) but the
#: two characters that texts consist of, and their meetings.
_ODD = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"] + ["  ", "\n\n", " \n", "\n "]
#: A word and its end marks, cut apart by either pattern in the one obvious way.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
#: What the characters of a plain word become: one byte letter per UTF-8 byte.
_LETTERS = {c: "".join(_BYTE_LETTERS[b] for b in chr(c).encode()) for c in range(0x100)}


class Encoder:
    def __init__(self, path: str, cache: int = CACHE, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.cache = cache
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.packed = [np.array([i], dtype=self.dtype).tobytes() for i in range(size)]
        with open(path) as f:
            self._kind(json.load(f), special_as_text)

    def _kind(self, file: dict, special_as_text: bool) -> None:
        """How texts are cut: ``sep`` parts the pieces of ``_ready`` texts; none if they stay whole."""
        pre = file.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        first, self.sep, self.lower = steps[0], None, False
        if len(steps) == 1 and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space"):
            self.sep = "\x00"
        pattern = first.get("pattern", {}).get("Regex", "")
        if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in pattern:
            self.sep, self.lower = " ", True
        self.added: list[str] = []
        for token in file.get("added_tokens") or []:
            if special_as_text and token["special"]:
                continue
            if token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"]:
                self.sep = None  # such a token reaches beyond its own characters
            self.added.append(token["content"])
        longest_first = sorted(self.added, key=len, reverse=True)
        self._split_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else None

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a text without added tokens."""
        if self.lower:
            return text.replace("\n", " ").split(" ")
        return [p for p in _CUT.split(text) if p]

    def _ready(self, text: str) -> str | None:
        """The text with ``sep`` between its pieces; None if its pieces may hold ``sep``."""
        if any(a in text for a in self.added):
            parts = [x if i % 2 else self._ready(x) for i, x in enumerate(self._split_added(text)) if x]
            return None if None in parts else self.sep.join(parts)
        if self.lower:
            return text.replace("\n", " ")
        if "\x00" in text:
            return None
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in _ODD):
            return "\x00".join(self._pieces(text))
        # No two spaces meet, so every space starts a piece and a line end is one.
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00")

    def _ask(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are not remembered.

        A plain word goes straight to the library's model (one pre-token), and a
        word with end marks is two such pieces; the rest are encoded as texts.
        """
        out: list[bytes | None] = [None] * len(pieces)
        rest, words = [], {}
        packed, tokenize, plain, new, old, lower = self.packed, self.tokenizer.model.tokenize, _PLAIN.fullmatch, self.new, self.old, self.lower
        for i, x in enumerate(pieces):
            m = plain(x)
            if m is None or lower and x[0] == " ":
                rest.append(i)
                continue
            both = b""
            for word in m.groups():
                if word:
                    got = words.get(word) or new.get(word) or old.get(word)
                    if got is None:
                        low = word.lower() if lower else word
                        letters = ("Ġ" + low[1:] if low[0] == " " else low) if low.isascii() else low.translate(_LETTERS)
                        got = words[word] = b"".join([packed[t.id] for t in tokenize(letters)])
                    both = both + got if both else got
            out[i] = both
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for j, e in zip(some, self.tokenizer.encode_batch_fast([pieces[j] for j in some], add_special_tokens=False)):
                out[j] = b"".join([packed[t] for t in e.ids])
        return out

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, remembered or asked for."""
        found = list(map(self.new.get, pieces))
        if None not in found:
            return found
        missing = [i for i, y in enumerate(found) if y is None]
        ask = []
        for i in missing:
            if (y := self.old.get(pieces[i])) is None:
                ask.append(i)
            else:
                found[i] = y
        for i, y in zip(ask, self._ask([pieces[i] for i in ask])):
            found[i] = y
        if len(self.new) + len(missing) > self.cache:
            self.old, self.new = self.new, {}
        if len(missing) <= self.cache:
            self.new.update((pieces[i], found[i]) for i in missing if len(pieces[i]) <= LONGEST)
        return found

    def _parts(self, text: str):
        """The text in parts of about ``PART`` characters that no piece reaches across.

        A word that is longer than that stays in one part.
        """
        at = 0
        while len(text) - at > PART:
            if self.lower:
                stop = text.find(" ", at + PART)
            else:
                cut = _CUT.search(text, at + PART)
                stop = cut.start() if cut else -1
            if stop < 0:
                break
            yield text[at:stop]
            at = stop
        yield text[at:] if at else text

    def _whole(self, text: str) -> bytes:
        """A text that cannot be cut by ``sep``."""
        if self.sep is None:
            return b"".join([self.packed[t] for t in self.tokenizer.encode(text, add_special_tokens=False).ids])
        parts = [[x] if i % 2 else self._pieces(x) for i, x in enumerate(self._split_added(text))] if self.added else [self._pieces(text)]
        pieces = [p for x in parts for p in x]
        ids = dict(zip(known := list(dict.fromkeys(pieces)), self._lookup(known)))
        return b"".join([ids[p] for p in pieces])

    def _together(self, ready: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of ``_ready`` texts."""
        lists = pc.split_pattern(pa.array(ready, pa.large_string()), self.sep)
        coded = lists.values.dictionary_encode()
        ids = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.dtype.itemsize
        table, first = np.frombuffer(b"".join(ids), dtype=self.dtype), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])
        return table[at], np.diff(ends[lists.offsets.to_numpy()])

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (``dtype``) of all texts in one array, and the number of each text's ids.

        Besides the texts and their ids, memory holds about ``GROUP`` characters'
        worth of pieces at a time, however long a text is.
        """
        counts = np.zeros(len(texts), dtype=np.int64)
        flat, ready, owner, waiting = [], [], [], 0

        def flush():
            nonlocal ready, owner, waiting
            if ready:
                ids, n = self._together(ready)
                flat.append(ids)
                np.add.at(counts, owner, n)
                ready, owner, waiting = [], [], 0

        for i, text in enumerate(texts):
            for part in self._parts(text) if text and self.sep is not None else [text] if text else []:
                r = self._ready(part) if self.sep is not None else None
                if r is None:
                    flush()
                    flat.append(np.frombuffer(self._whole(part), dtype=self.dtype))
                    counts[i] += len(flat[-1])
                    continue
                ready.append(r)
                owner.append(i)
                waiting += len(r)
                if waiting > GROUP:
                    flush()
        flush()
        return np.concatenate(flat) if flat else np.empty(0, dtype=self.dtype), counts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """An array of ids (``dtype``) per text; null and empty texts have none."""
        flat, counts = self.encode_flat(texts)
        return np.split(flat, np.cumsum(counts)[:-1]) if len(texts) else []


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False, cache: int = CACHE) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path, cache, special_as_text)


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
