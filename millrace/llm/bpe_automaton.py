"""BPE encoding and decoding with a deterministic automaton compiled from the merge list.

The automaton reads tokens. It starts as one state that loops on every base symbol; then each
merge (u, v) -> w is worked in, in order of priority, by a *merge gadget*:

* the state that u leads to is split: a copy, without the arc v, takes over all arcs u;
* wherever u could be followed by v, an arc w is added beside u, which leads to where v led.

What it accepts in the end are exactly the token sequences that the merges produce, so a word's
encoding is the one path whose labels spell the word. All arcs of one token lead to one state, and
a copy differs from its original by one arc. So the compiled arcs are, for each token, the
tokens it was merged from, when, and the arcs its state lost at which merge.

To read bytes, the arcs are spelled by the bytes of their tokens, which makes the automaton deterministic over
bytes: a state is the longest end of what was read that begins an arc, with the last tokens of the
beginnings that an arc may still start from. Every byte is one look into the table of moves. A move that is not in the
table yet is worked out when it is first made: of the arcs that end at this byte exactly one comes from the path
that led to where it starts, and its token is the new state's last one. Nothing is taken back: the word's tokens
are read off from its end. Table and stores have bounds, and are emptied when a task ends.

Decoding emits the labels of the arcs, with one blank between them (the vocabulary's file has no decoder).

Edge cases: a null or empty text has no tokens; the two control strings of the vocabulary are
found in the raw text before anything else, as its library does; texts and words of any length are encoded
whole, in time and memory in proportion to them. Rows may repeat and ids may be null. Letters and digits are
those that Python's Unicode tables know, and marks are ordered as there, with the fixed values below (as measured with Python 3.13).
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DIGEST_TYPE = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
ENCODED_TYPE = "struct<ids: array<int>, decoded_sha256: string>"
#: Bounds on what a worker keeps: states of the table over bytes, pieces of words, and (twice as many, and those of one text) runs of text without white space.
MOST_STATES, MOST_WORDS, MOST_CHUNKS = 3 << 16, 1 << 15, 1 << 17
#: Longer pieces and runs are not kept.
LONG = 64


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


# Letters and digits that the vocabulary's library knows and Python 3.13 does not (first and last code point).
LATER = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
# Small letters of capitals that Python 3.13 does not know.
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEW_CAPITAL = re.compile("[" + "".join(map(chr, SMALL)) + "]")

# Combining marks that Python 3.13 reorders and the vocabulary's library, whose tables are older, leaves
# where they are; and U+11930, which it does not compose.
UNORDERED = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
_UNORDERED = re.compile("([" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in UNORDERED) + "])")


@lru_cache(maxsize=1)
def _unknown() -> str:
    """A character class of the code points that ``regex`` takes for letters or digits and the vocabulary's library does not."""
    import regex

    told = regex.compile(r"[\p{L}\p{N}]")
    later = {c for lo, hi in LATER for c in range(lo, hi + 1)}
    odd: list[int] = []
    for lo in range(0x80, sys.maxunicode + 1, 1 << 12):  # a part at a time, as all of them take much room
        none = "".join(x for x in map(chr, range(lo, min(lo + (1 << 12), sys.maxunicode + 1))) if unicodedata.category(x) == "Cn")
        odd += [c for c in map(ord, told.findall(none)) if c not in later]
    runs: list[list[int]] = []
    for c in odd:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in runs)


class Automaton:
    """The compiled tables of one vocabulary file.

    ``first[t]``, ``second[t]``, ``made[t]``: the parts of token t and the number of its merge (-1:
    base symbol). ``lost[u]``: the arcs that the state behind token u lost, with the merge at which
    it was split for it; ``split[u]``: the first such merge. ``spelling``, ``shorter``, ``depth``, ``ends``: the moves of the tokens'
    spelling, the state of the next shorter end, how many bytes lead to a state, and the tokens that end at it with their lengths, the
    longest first. ``move``, ``states``, ``last``: the table over bytes, what its states stand for, and the token that ends at each.
    """

    def __init__(self, vocabulary: dict) -> None:
        model = vocabulary["model"]
        self.labels: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in vocabulary["added_tokens"]}
        self.labels |= {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        self._compile(model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]])
        self._spell(model["vocab"])
        self.room = 1
        self.forget()
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = vocabulary["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        import regex  # its \p{..} classes are what the pattern needs

        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{_unknown()}]]") if _unknown() else pattern
        self.pieces = regex.compile("(?V1)" + pattern)
        self.white = regex.compile(r"\p{White_Space}+")
        self.odd = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the pattern
        self.ends_alone = {x for x in ",.;:!?" if self.pieces.findall(f"ab{x}") == ["ab", x]}  # what is one piece behind letters

    def _compile(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        size = max(vocab.values()) + 1
        self.first, self.second, self.made = [-1] * size, [-1] * size, [-1] * size
        self.lost: dict[int, dict[int, int]] = {}
        self.split = [len(merges)] * size
        self.never = len(merges) + 1
        for k, (one, two) in enumerate(merges):
            u, v, w = vocab[one], vocab[two], vocab[one + two]
            if self.has_arc(u, v):  # else no path reaches this merge
                self.lost.setdefault(u, {})[v] = k
                self.split[u] = min(self.split[u], k)
                self.first[w], self.second[w], self.made[w] = u, v, k

    def has_arc(self, u: int, t: int) -> bool:
        """Whether token t may follow token u: looked up in the compiled arcs."""
        now = self.never  # later than any merge
        while True:
            lost = self.lost.get(u)
            if lost is not None and lost.get(t, now + 1) <= now:
                return False
            if self.made[t] >= self.split[u]:
                # It came to u's state after a split, beside its first part: look whether that was there then.
                now = min(now, self.made[t])
                t = self.first[t]
            elif self.made[u] >= 0:
                # u's state was, when u was made, that of its second part.
                now = self.made[u] - 1
                u = self.second[u]
            else:
                return True  # the first state, that loops on everything

    def _spell(self, vocab: dict[str, int]) -> None:
        """The byte table: state * 512 + symbol -> state. A symbol is a byte, 256 more for one that ends a word."""
        number = {x: b for b, x in enumerate(_byte_symbols())}
        self.spelling: dict[int, int] = {}
        self.length = [0] * len(self.first)
        own: dict[int, int] = {}
        self.depth = [0]
        states = 1
        for token, i in vocab.items():
            closed = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            symbols = [number[x] for x in (token[: -len(self.end)] if closed else token)]
            symbols[-1] += 256 * closed
            state = 0
            for x in symbols:
                deeper = self.depth[state] + 1
                state = self.spelling.setdefault(state << 9 | x, states)
                if state == states:
                    states += 1
                    self.depth.append(deeper)
            own[state], self.length[i] = i, len(symbols)
        self.shorter: list[int] = [0] * states
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * states
        after: list[list[tuple[int, int]]] = [[] for _ in range(states)]
        for key, to in self.spelling.items():
            after[key >> 9].append((key & 511, to))
        level = [0]
        while level:  # by the length of what they spell
            for state in level:
                for x, to in after[state]:
                    back = self._next(self.shorter[state], x) if state else 0
                    self.shorter[to] = back
                    self.ends[to] = ((own[to], self.length[own[to]]), *self.ends[back]) if to in own else self.ends[back]
            level = [to for state in level for _, to in after[state]]

    def _next(self, state: int, symbol: int) -> int:
        """The spelling's state after one more symbol."""
        while True:
            to = self.spelling.get(state << 9 | symbol)
            if to is not None:
                return to
            if not state:
                return 0
            state = self.shorter[state]

    def forget(self) -> None:
        """Empty the stores of runs and pieces, and go back to the first state alone."""
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.words: dict[str, list[int]] = {}
        self._restart()

    def _restart(self) -> None:
        """Back to the first state alone."""
        self.move: dict[int, int] = {}
        self.number: dict[tuple[int, tuple[int, ...]], int] = {(0, (-1,)): 0}
        self.states: list[tuple[int, tuple[int, ...]]] = [(0, (-1,))]
        self.last: list[int] = [-1]
        self.pairs: dict[int, bool] = {}

    def _fill(self, state: int, symbol: int) -> int:
        """Work out one move: spell on, and see which of the arcs that end here comes from the path that led to where it starts."""
        spelled, lasts = self.states[state >> 9]
        spelled, pairs = self._next(spelled, symbol), self.pairs
        for t, size in self.ends[spelled]:
            before = lasts[-size]
            ok = pairs.get(before << 20 | t)
            if ok is None:
                ok = pairs[before << 20 | t] = before < 0 or self.has_arc(before, t)
            if ok:
                break
        # An arc that ends later begins where the longest beginning of an arc begins, at the earliest.
        reached = spelled, (*lasts, t)[-1 - self.depth[spelled] :]
        to = self.number.get(reached)
        if to is None:
            to = self.number[reached] = len(self.states) << 9  # with room for a symbol
            self.states.append(reached)
            self.last.append(t)
        self.move[state | symbol] = to
        return to

    def encode_word(self, word: str) -> list[int]:
        """The ids of one piece of text: one look into the table of moves for each of its bytes, then the tokens from its end."""
        symbols = list(word.encode())
        if self.end:
            symbols[-1] += 256
        if len(self.states) >= self.room * MOST_STATES:
            self._restart()
        move, state, path = self.move, 0, []
        for x in symbols:
            try:
                state = move[state | x]
            except KeyError:
                state = self._fill(state, x)
            path.append(state)
        last, length = self.last, self.length
        out, i = [], len(path)
        while i > 0:
            t = last[path[i - 1] >> 9]
            out.append(t)
            i -= length[t]
        out.reverse()
        return out

    def _known(self, chunk: str) -> tuple[bytes, str]:
        """What a run encodes and decodes to, from the stores if it is there; if not, it is stored."""
        found = self.chunks.get(chunk) or self.older.get(chunk) or self._chunk(chunk)
        if len(chunk) <= LONG:
            self.chunks[chunk] = found
        return found

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """What a run of text without white space encodes to, as bytes of its ids, and decodes to."""
        if chunk.isascii():
            text = chunk.lower()
            if text != chunk:
                return self._known(text)
            if text.isalpha():  # one piece
                return self._packed(self.encode_word(text))
            if text[:-1].isalpha() and text[-1] in self.ends_alone:  # two
                (ids, said), (end_ids, end) = self._known(text[:-1]), self._known(text[-1])
                return ids + end_ids, f"{said} {end}"
        else:
            text = normal(chunk)
        out: list[int] = []
        for piece in self.pieces.findall(text):
            ids = self.words.get(piece)
            if ids is None:
                ids = self.encode_word(piece)
                if len(piece) <= LONG:
                    if len(self.words) >= self.room * MOST_WORDS:
                        self.words.clear()
                    self.words[piece] = ids
            out += ids
        return self._packed(out)

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def runs(self, text: str) -> list[tuple[bytes, str]]:
        """Bytes of the ids of each run of characters between white space, and what they decode to. Pieces never cross white
        space, so each distinct run is worked out once, as long as the stores of runs, pieces and moves have room."""
        if len(self.chunks) >= self.room * MOST_CHUNKS:  # what was asked for since then is kept, the rest goes the next time
            self.older, self.chunks = self.chunks, {}
        known, older, out, long = self.chunks, self.older, [], []
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                out.append((struct.pack("<I", self.special[part]), part))
                continue
            chunks = self.white.split(part) if self.odd.search(part) else part.split()
            for chunk in set(chunks).difference(known):
                known[chunk] = older.get(chunk) or self._chunk(chunk)
                if len(chunk) > LONG:
                    long.append(chunk)
            out += map(known.__getitem__, chunks)
        for chunk in long:
            known.pop(chunk, None)
        return [x for x in out if x[0]]  # an empty string stands before and behind white space

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return np.frombuffer(b"".join([x[0] for x in self.runs(text)]), "<u4")

    def decode(self, ids) -> str:
        labels = self.labels
        return " ".join([labels[int(i)] for i in ids])


def normal(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is not treated apart). What stands on either side of a
    mark without an order is normalised on its own, as no other mark moves past it."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = "".join([unicodedata.normalize("NFC", part) for part in _UNORDERED.split(text)])
        text = text.translate(SMALL) if _NEW_CAPITAL.search(text) else text
    return text.replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def _compiled(vocabulary: str) -> Automaton:
    return Automaton(json.loads(vocabulary))


def read_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast string: its size is that of the file, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _mapped(text: Column, vocabulary, kind: str, work: Callable[[Automaton, pa.Array], pa.Array], room: int = 1) -> Column:
    """``work`` on each batch of texts, with ``room`` times the stores' bounds; the stores are emptied behind a task's last batch, as its
    worker goes on to other work."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _compiled(vocabulary.value)
        automaton.room = room
        try:
            for texts in batches:
                yield work(automaton, texts)
        finally:
            automaton.forget()

    return F.arrow_udf(run, kind).asNondeterministic()(text)


def ids(text: Column, vocabulary) -> Column:
    """The token ids of each text as an array."""

    def work(automaton: Automaton, texts: pa.Array) -> pa.Array:
        return pa.array([automaton.encode(t.as_py() or "").astype(np.int32) for t in texts], pa.list_(pa.int32()))

    return _mapped(text, vocabulary, "array<int>", work)


def encoded(text: Column, vocabulary) -> Column:
    """A struct of the token ids of each text and the SHA-256 of what they decode to, both from one pass."""

    def work(automaton: Automaton, texts: pa.Array) -> pa.Array:
        parts, hashes = [np.zeros(0, np.int32)], []
        for t in texts:
            found = automaton.runs(t.as_py() or "")
            parts.append(np.frombuffer(b"".join([x[0] for x in found]), "<i4"))
            hashes.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
        ends = pa.array(np.cumsum([len(p) for p in parts]), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts))), pa.array(hashes, pa.string())], ["ids", "decoded_sha256"])

    return _mapped(text, vocabulary, ENCODED_TYPE, work)


def digests(text: Column, vocabulary, room: int = 3) -> Column:
    """A struct with the number of tokens, the SHA-256 of the ids (unsigned 32 bit, little end first) and of the decoded text.

    Made row by row, so that at most one document's ids are in memory beside the batch of texts.
    """

    def work(automaton: Automaton, texts: pa.Array) -> pa.Array:
        counts, hashes, backs = [], [], []
        for t in texts:
            found = automaton.runs(t.as_py() or "")
            ids = b"".join([x[0] for x in found])
            counts.append(len(ids) // 4)
            hashes.append(hashlib.sha256(ids).hexdigest())
            backs.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
        columns = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(backs, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(text, vocabulary, DIGEST_TYPE, work, room)
