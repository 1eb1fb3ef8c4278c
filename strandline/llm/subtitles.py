"""The spoken words of a subtitle file, in file order, and the ways misread characters spoil them.

`spoken_words` reads numbered cues in any of four layouts and leaves out everything that isn't speech: numbers, times,
markup, headers, line-break marks and sound descriptions; wrongly decoded text is put right where its bytes allow it.
A word is what blanks part, in lower case, without punctuation.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

_CONT = "".join(sorted({bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xC0)} | {chr(b) for b in range(0x80, 0xC0)}))
_CONT = re.escape(_CONT)
#: UTF-8 bytes shown as single characters: a lead byte and continuation bytes, of which `_from` takes as many as the lead asks for.
_WRONG = re.compile(f"[\xc2-\xf4][{_CONT}]{{1,3}}")
_LOST = re.compile("[\xc2-\xc5�]�")
_BYTE = {bytes([b]).decode("cp1252", "ignore"): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0x100)}
_BYTE.pop("", None)
#: The same bytes shown as Cyrillic. Its small and capital yo stand in real words too, so they need a Latin letter beside.
_BYTE_1251 = {bytes([b]).decode("cp1251", "ignore"): b for b in range(0x80, 0x100)} | {"\x98": 0x98}
_BYTE_1251.pop("", None)
_CONT_1251 = re.escape("".join(c for c, b in _BYTE_1251.items() if b < 0xC0 and c not in "ёЁ"))
_WRONG_1251 = re.compile(f"[В-п][{_CONT_1251}]{{1,2}}")
_YO_1251 = re.compile("(?<=[a-zA-Z])Г[ёЁ]|Г[ёЁ](?=[a-zA-Z])")

_TIMED = re.compile(r"(?m)(?:^[ \t﻿]*[0-9lIOoSBZiz|gqDQ#]{1,7}[ \t]*\r?\n)?^[^\n]*-->[^\n]*$")
_HEADER = re.compile(r"^﻿?\s*WE[B8]VTT[^\n]*")
#: The fields before a line's text; their commas may be misread as stops or quotes.
_ASS = re.compile(r"(?m)^﻿?[^\s:]{5,}+:[^\n]{20,}?(?<![,.'’])[,.'’]++[0oOQ][,.'’]++[0oOQ][,.'’]++[0oOQ][,.'’]{1,2}")
#: Frame numbers before a cue of one line.
_FRAMES = re.compile(r"(?m)^﻿?\{\d+\}\{\d+\}")
#: Sound descriptions: between brackets up to the end of the cue (an empty line), between other marks up to the end of the line.
_IN_BRACKETS = re.compile(r"\[[^\[\]\n]*+(?:\n(?![ \t]*\n)[^\[\]\n]*+)*+\]|\([^()\n]*+(?:\n(?![ \t]*\n)[^()\n]*+)*+\)")
_IN_NOTES = re.compile(r"♪[^♪\n]*♪|🎵[^🎵\n]*🎵")
_IN_STARS = re.compile(r"(?m:^[ \t-]*\*[^*\n]+\*[ \t\r]*$)|\*[a-zA-Z][^*\n]+\*")
_IN_OTHER = re.compile(r"(?m)^[ \t-]*[?#][ \t][^?#\n]*[?#][ \t\r]*$")
_BRACES = re.compile(r"\{[^{}\n]*\}")
_TAG = re.compile(r"<[^<>\n]*>")
_BREAK = re.compile(r"\\[NnhH]|\|")
_NUMBER_LINE = re.compile(r"(?m)^[\W\d_]+$")
#: Apart from letters and digits, characters that stand for a letter in misread or lost text.
_NOT_WORD = re.compile(r"[^\w+#\ufffd]|_")


def _from(table: dict[str, int]):
    def put_right(m: re.Match) -> str:
        whole = bytes(table[c] for c in m[0])
        n = 2 if whole[0] < 0xE0 else 3 if whole[0] < 0xF0 else 4
        try:
            return whole[:n].decode() + m[0][n:]
        except UnicodeDecodeError:
            return m[0]

    return put_right


_from_1252, _from_1251 = _from(_BYTE), _from(_BYTE_1251)


def repair(text: str) -> str:
    """Undoes UTF-8 read as a one-byte encoding, as often as it happened; every round shortens the text."""
    while True:
        fixed = _WRONG_1251.sub(_from_1251, _WRONG.sub(_from_1252, text))
        if "Г" in fixed:
            fixed = _YO_1251.sub(_from_1251, fixed)
        if fixed == text:
            return _LOST.sub("\ufffd", text) if "\ufffd" in text else text
        text = fixed


def spoken_parts(text: str | None) -> list[str]:
    """What blanks part in the speech of a file; `plain` makes words of it, or nothing of parts without letter or digit."""
    if not text:
        return []
    if not text.isascii():
        text = repair(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "&" in text:
        text = html.unescape(text)
    text = _HEADER.sub("", text)
    if "-->" in text:
        text = _TIMED.sub("\n", text)
    if "0,0" in text:  # some line of such a file has it whole
        text = _ASS.sub("\n", text)
    if "{" in text:
        text = _BRACES.sub("", _FRAMES.sub("\n", text))
    if "\\" in text or "|" in text:
        text = _BREAK.sub("\n", text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "[" in text or "(" in text:
        text = _IN_BRACKETS.sub(" ", text)
    if "♪" in text or "🎵" in text:
        text = _IN_NOTES.sub(" ", text)
    if "*" in text:
        text = _IN_STARS.sub(" ", text)
    if "?" in text or "#" in text:
        text = _IN_OTHER.sub(" ", text)
    return _NUMBER_LINE.sub(" ", text).split()


def spoken_words(text: str | None) -> list[str]:
    return [w for w in map(plain, spoken_parts(text)) if w]


def plain(word: str) -> str:
    """A word in lower case without punctuation; '' where no letter or digit is left."""
    return _plain(word) if len(word) < 64 else _plain.__wrapped__(word)


@lru_cache(100_000)
def _plain(word: str) -> str:
    w = _NOT_WORD.sub("", unicodedata.normalize("NFC", word.lower())) if not word.isalpha() else word.lower()
    return w if any(c.isalnum() or c == "\ufffd" for c in w) else ""


#: What a letter is misread as, besides itself.
MISREAD = {
    "a": ["o", "4"], "b": ["8", "h", "6"], "c": ["("], "d": ["cl"], "e": ["c", "3"], "f": ["t"], "g": ["q", "9", "6"], "h": ["b", "li"], "i": ["j", "l", "1"], "j": ["i"],
    "l": ["i", "1", "7"], "m": ["rn", "nn"], "n": ["u", "ri", "ii"], "o": ["0", "c", "q"], "q": ["g", "9"], "r": ["n", "i"], "s": ["5", "z", "8"], "t": ["f", "+", "7"], "u": ["n", "ii", "v"],
    "v": ["y", "u"], "w": ["vv", "uu"], "y": ["v"], "z": ["s", "2"],
}
#: A letter may be misread twice (r as n, n as u).
_TWICE = {c: {*forms, *(g for f in forms for g in MISREAD.get(f, ()))} for c, forms in MISREAD.items()}
_ACCENTS = {}
for _c in map(chr, range(0xC0, 0x250)):
    _b = unicodedata.normalize("NFD", _c.lower())[0]
    if _b.isascii():
        _ACCENTS.setdefault(_b, set()).add(_c.lower())


@lru_cache(10_000)
def ways(c: str) -> tuple[str, ...]:
    """What may stand for a letter: itself, misread, with its accent changed, or lost to wrong decoding; the longest first."""
    base = unicodedata.normalize("NFD", c)[0] if c > "\x7f" else c
    forms = {c, base, "#", "\ufffd", *_TWICE.get(base, ()), *_ACCENTS.get(base, ())}
    if c in "øßæœ":
        forms |= {"o", "ss", "ae", "oe", "0", "b", "8"}
    return tuple(sorted(forms, key=lambda w: (-len(w), w)))


class Node:
    """A prefix of some terms: letters that go on, the term that ends here, and the steps by their first character."""

    __slots__ = ("on", "term", "steps", "skips")

    def __init__(self):
        self.on: dict[str, Node] = {}
        self.term = 0
        self.steps: dict[str, list[tuple[str, Node]]] | None = None
        self.skips: list[Node] = []

    def prepare(self) -> dict:
        self.steps = {}
        for c, child in self.on.items():
            for w in ways(c):
                self.steps.setdefault(w[0], []).append((w, child))
        self.skips = [child for c, child in self.on.items() if c > "\x7f"]
        return self.steps


class Vocabulary:
    """Ids of known words; `resolve` gives a word's own and those whose spoilt form it may be, known word or not.

    Each letter of a term stands in one of its `ways`, letters with an accent may be missing. The terms are a trie, through
    which a word goes on all ways at once, so terms that part from it are left at the letter where they do.
    """

    REMEMBER = 400_000

    def __init__(self, words):
        self.root = Node()
        self.known: dict[str, tuple[int, ...]] = {}
        for i, w in enumerate(words):
            node = self.root
            for c in w:
                node = node.on.setdefault(c, Node()) if c not in node.on else node.on[c]
            node.term = i + 1
        self.longest = 2 * max(map(len, words), default=0)  # a letter is misread as two at most

    def resolve(self, word: str) -> tuple[int, ...]:
        if len(word) > self.longest:
            return ()
        found = self.known.get(word)
        if found is None:
            if len(self.known) > self.REMEMBER:
                self.known = {}
            found = self.known[word] = self._search(word)
        return found

    def _search(self, word: str) -> tuple[int, ...]:
        found, end = set(), len(word)
        states = [(self.root, 0)]
        seen = set()
        while states:
            node, at = states.pop()
            steps = node.prepare() if node.steps is None else node.steps
            if at == end:
                if node.term:
                    found.add(node.term)
            else:
                for w, child in steps.get(word[at], ()):
                    if len(w) == 1 or word.startswith(w, at):
                        state = (child, at + len(w))
                        if state not in seen:
                            seen.add(state)
                            states.append(state)
            for child in node.skips:
                if (child, at) not in seen:
                    seen.add((child, at))
                    states.append((child, at))
        return tuple(sorted(found))
