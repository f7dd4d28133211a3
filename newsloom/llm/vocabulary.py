"""Vocabulary files of public byte-pair tokenizers, and the split of a text into pre-tokens.

Two file formats of the ``tokenizers`` library are read here: byte-level BPE whose pre-tokens
carry their leading space, and BPE with word ends, lower case and dropped white space. The
merges themselves belong to the operators (:mod:`.bpe`, :mod:`.token_counts`).

A text is split at its single spaces first. No pre-token of either kind reaches across such a
space, so a chunk's tokens depend on the chunk alone and can be kept for the next time.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import regex


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the others take the code points from 256 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: Above it, character classes differ between Unicode versions: the library splits those itself.
PLAIN = re.compile("[^\x00-˿]")


CONTROLS = re.compile("[\x1c-\x1f]")


#: Marks that are a pre-token of their own after letters.
MARKS = frozenset(".,;:!?")
#: Before a part without a space before it, and for a line feed: no text holds surrogates.
HEAD, LINE = "\ud800", "\ud801"
#: White space that would join a line feed beside it.
BESIDE = ("\n\n", "\n ", " \n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")


class Vocabulary:
    """Ids, merges and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self.strings: list[str] = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = token
        self.word_end: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        #: (left id, right id) -> (rank, id of both)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.merges[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        self.letters = byte_letters()
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.library = Tokenizer.from_file(path)

    def symbols(self, word: str) -> list[int]:
        """Ids of a pre-token's single bytes, the last with the word end."""
        marks = [self.letters[b] for b in word.encode()]
        if marks and self.word_end:
            marks[-1] += self.word_end
        return [self.ids[m] for m in marks if m in self.ids]

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text between special tokens, each with the id of the one that follows it."""
        if "<|" not in text and all(s.startswith("<|") for s in self.special):
            return [(text, None)]
        parts, at = [], 0
        for m in self.specials.finditer(text):
            parts.append((text[at : m.start()], self.special[m[0]]))
            at = m.end()
        return [*parts, (text[at:], None)]


class SpacedVocabulary(Vocabulary):
    """Byte-level BPE: a pre-token may begin with one space."""

    lead = " "

    @cached_property
    def pattern(self) -> regex.Pattern:
        # Fixed value: the published split pattern of this vocabulary.
        return regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )

    def chunks(self, segment: str) -> list[str] | None:
        """Parts that hold whole pre-tokens: with HEAD as they are, without it after one space.
        A line feed alone between others is the part LINE. None for runs of spaces, which only
        the pattern splits."""
        if "  " in segment:
            return None
        if "\n" in segment and not any(x in segment for x in BESIDE) and (segment.isascii() or not PLAIN.search(segment)):
            segment = segment.replace("\n", f" {LINE} {HEAD}")
        return (HEAD + segment).split(" ")

    def words(self, chunk: str) -> list[str]:
        if not chunk.isascii() and PLAIN.search(chunk):
            return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return self.pattern.findall(chunk)


class WordVocabulary(Vocabulary):
    """BPE with word ends: lower case, white space dropped."""

    lead = ""

    @cached_property
    def pattern(self) -> regex.Pattern:
        # Fixed value: the published split pattern of this vocabulary.
        return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def chunks(self, segment: str) -> list[str]:
        if PLAIN.search(segment):
            segment = self.library.normalizer.normalize_str(segment)
        else:
            segment = segment.lower()
        # str.split() takes four control characters for white space that the pattern keeps
        return regex.split(r"\s+", segment) if CONTROLS.search(segment) else segment.split()

    def words(self, chunk: str) -> list[str]:
        if not chunk.isascii() and PLAIN.search(chunk):
            return [chunk[a:b] for a, b in self._spans(chunk)]
        return self.pattern.findall(chunk)

    def _spans(self, chunk: str) -> list[tuple[int, int]]:
        return [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(chunk)]


class Tokens:
    """Per-chunk values of whole texts: sums of counts, or joined id bytes.

    ``solve`` takes the pre-tokens not seen lately, all at once, and gives a value for each;
    ``join`` puts values together. Values are kept for about ``limit`` chunks; what comes later
    is worked out for its batch alone, which costs time and changes no result. When many chunks
    of a batch are new, the memory starts afresh.
    """

    def __init__(self, vocabulary, solve, join, special, limit: int = 300_000, long: int = 60, direct=None):
        self.vocabulary, self.solve, self.join, self.special = vocabulary, solve, join, special
        self.direct = direct  # gives the values of whole chunks, where a library splits them itself
        self.limit, self.long = limit, long
        self.by_word: dict = dict(zip(MARKS, solve(list(MARKS)), strict=True))
        self.fixed = {LINE: solve(["\n"])[0]} if vocabulary.lead else {}
        self.by_chunk: dict = dict(self.fixed)

    def of(self, texts: list[str]) -> list:
        """The value of each text."""
        laid, new, whole, total, get = [], set(), set(), 0, self.by_chunk.get
        for text in texts:
            parts = []
            for segment, special in self.vocabulary.segments(text):
                chunks = self.vocabulary.chunks(segment)
                if chunks is None:
                    words = self.vocabulary.words(segment)
                    whole.update(words)
                    parts.append((words, None, (), special))
                    continue
                total += len(chunks)
                values, gaps, at = list(map(get, chunks)), [], -1
                for _ in range(values.count(None)):
                    at = values.index(None, at + 1)
                    gaps.append(at)
                    new.add(chunks[at])
                parts.append((chunks, values, gaps, special))
            laid.append(parts)
        passing = self._learn(new, whole, total)
        out = [self.join([self._value(*p) for p in parts]) for parts in laid]
        for table, keys in passing:
            for key in keys:
                del table[key]
        return out

    def _value(self, chunks, values, gaps, special):
        if values is None:
            values = [self.by_word[w] for w in chunks]
        table = self.by_chunk
        for at in gaps:
            values[at] = table[chunks[at]]
        if special is not None:
            values.append(self.special(special))
        return self.join(values)

    def _learn(self, new, whole, total) -> list:
        """Works out what the batch of ``total`` chunks needs; returns (table, keys) that
        shouldn't be kept."""
        split, lead, known, table = self.vocabulary.words, self.vocabulary.lead, self.by_word, self.by_chunk
        plain: dict[str, str] = {}
        tailed, odd, search = [], [], PLAIN.search
        for c in new:
            word, own = (c[1:], "") if c[:1] == HEAD else (c, lead)
            # letters alone are one pre-token, with a mark after them two: no need for the pattern
            if word.isascii() or not search(word):
                if self.direct or word.isalpha():
                    plain[c] = own + word
                    continue
                if word[-1:] in MARKS and word[:-1].isalpha():
                    tailed.append(c)
                    if c[:-1] not in table:
                        plain[c[:-1]] = own + word[:-1]
                    continue
            odd.append((c, split(own + word)))
        unseen = list(whole.union(*[ws for _, ws in odd]).difference(known))
        if self.direct:
            table.update(zip(plain, self.direct(plain.values()), strict=True))
            known.update(zip(unseen, self.solve(unseen), strict=True))
        else:
            values = self.solve([*plain.values(), *unseen])
            table.update(zip(plain, values, strict=False))
            known.update(zip(unseen, values[len(plain) :], strict=True))
        join = self.join
        for c in tailed:
            table[c] = join((table[c[:-1]], known[c[-1]]))
        for c, ws in odd:
            table[c] = join([known[w] for w in ws])
        out = []
        fresh = [*plain, *tailed, *[c for c, _ in odd]]
        for into, keys, kept in ((table, fresh, self.fixed), (known, unseen, MARKS)):
            if len(into) > self.limit:
                out.append((into, keys if 3 * len(new) < total else [k for k in into if k not in kept]))
            else:
                out.append((into, [k for k in keys if len(k) > self.long]))
        return out
