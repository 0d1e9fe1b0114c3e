"""One form for texts that look alike (problem 8).

Characters fall into classes: what can't be seen belongs to none, all single spaces are one, full-width forms
are their ordinary forms, and letters of the Latin, Cyrillic and Greek scripts that are drawn alike are one.
Accents are taken apart before and put together after, so that it does not matter how they were composed.

Spelling every class by one letter would be consistent but turn a Russian word into a mixture of scripts.  So
the words of the corpus that are written in one script make a vocabulary, a trie of their letters, with one
canonical spelling for each string of classes: in Latin where every class has a Latin letter, else the commonest.
A word is followed through the trie by an edit automaton with weights.  An unseen character, and a letter for
another that is drawn alike, cost nothing; every other edit can be seen, so that its cost is above what is
allowed, which is nothing, and it is not followed.  The automaton is in several places of the trie at once, as
a letter can stand for letters of three scripts.  A word that it finds comes out in the canonical spelling; any
other is spelled by the table of classes.  What is found depends on classes only, so that texts that look alike
always get the same form.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins
from ..session import commonest, cut, spread

# Characters that can't be seen, single spaces, and letters drawn like Latin ones.
UNSEEN = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180E, *range(0x180B, 0x180E), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10), *range(0xFFF9, 0xFFFC), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0), *range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0)]
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
CYRILLIC = "АВСЕНІЈКМОРЅТХУҮԌԚԜӀ асеһіјорԛѕхуүԁԝѵ"
CYRILLIC_AS = "ABCEHIJKMOPSTXYYGQWI acehijopqsxyydwv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονΓΠΦ"
GREEK_AS = "ABEZHIKMNOPTYXCjovГПФ"  # the last three: drawn like Cyrillic letters that no Latin one is like
FULL_WIDTH_SIGNS, FULL_WIDTH_AS = "￠￡￢￣￤￥￦", "¢£¬¯¦¥₩"



def _ranges(codes: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in sorted(codes):
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


_JOINER, _EMOJI_FORM = "\ue0fe", "\ue0ff"
ALIKE = {**dict(zip(CYRILLIC.replace(" ", ""), CYRILLIC_AS.replace(" ", ""), strict=True)), **dict(zip(GREEK, GREEK_AS, strict=True))}
#: Class to all letters that are drawn like it, itself first.
FACES = {k: k + "".join(c for c, x in ALIKE.items() if x == k) for k in dict.fromkeys(ALIKE.values())}
FULL_WIDTH = {0xFF01 + k: chr(0x21 + k) for k in range(94)}
TABLE: dict[int, str | None] = {
    **{c: None for c in UNSEEN},
    **{c: " " for c in SPACES},
    **FULL_WIDTH,
    **{ord(a): b for a, b in zip(FULL_WIDTH_SIGNS, FULL_WIDTH_AS, strict=True)},
    **{ord(a): b for a, b in ALIKE.items()},
    ord(_JOINER): "\u200d",
    ord(_EMOJI_FORM): "\ufe0f",
}
_UNSEEN_CLASS = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _ranges(UNSEEN))
_WORD = regex.compile(rf"[{_UNSEEN_CLASS}]*\p{{L}}[\p{{L}}\p{{M}}{_UNSEEN_CLASS}]*")
_LETTERS = re.compile("[A-Za-z]+")
# a joiner between two emoji makes another picture, and a variation selector after one changes how it is drawn
_EMOJI = r"[\p{Extended_Pictographic}\U0001f3fb-\U0001f3ff]"
_JOINED = regex.compile(rf"(?<={_EMOJI}\ufe0f?)\u200d(?={_EMOJI})")
_FORMED = regex.compile(rf"(?<={_EMOJI})\ufe0f")
_CONTROL = regex.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

#: Words of the vocabulary, and characters of the longest: about 6 MB are broadcast at most.
MOST_WORDS, LONGEST_WORD = 1 << 16, 48
_KEPT = 300_000


def protected(text: str) -> str:
    """With the joiners and selectors that can be seen put aside."""
    if "\u200d" in text:
        text = _JOINED.sub(_JOINER, text)
    if "\ufe0f" in text:
        text = _FORMED.sub(_EMOJI_FORM, text)
    return text


def classes(text: str) -> str:
    """The text by the table: a string that is equal for texts that look alike and for no others."""
    if text.isascii():
        return _CONTROL.sub("", text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", protected(text)).translate(TABLE))


def spelling(word: str) -> str | None:
    """The word as a candidate for the vocabulary: composed, nothing unseen or full-width, letters of one script
    only and at least one that has a look-alike, in Latin if that is possible; else None."""
    w = word if word.isascii() else unicodedata.normalize("NFC", "".join(c for c in word.translate(FULL_WIDTH) if TABLE.get(ord(c), c) is not None))
    if not 0 < len(w) <= LONGEST_WORD:
        return None
    if w.isascii():
        return w
    plain = unicodedata.normalize("NFD", w)
    if not any(c in ALIKE or c in FACES for c in plain):
        return None
    scripts = {s for c in w if c.isalpha() and (s := unicodedata.name(c, "").split(" ", 1)[0])}
    if len(scripts) != 1:
        return None
    k = plain.translate(TABLE)
    return unicodedata.normalize("NFC", k) if all(unicodedata.name(c, "").startswith("LATIN") for c in k if c.isalpha()) else w


class Vocabulary:
    """A trie of the letters of canonical spellings, one for a string of classes."""

    def __init__(self, spellings: list[str]):
        self.root: dict = {}
        for w in spellings:
            node = self.root
            for c in unicodedata.normalize("NFD", w):
                node = node.setdefault(c, {})
            node[""] = w
        self.cache: dict[str, str] = {}
        self.pieces: dict[str, str] = {}
        self.found = self.missed = 0

    def follow(self, word: str) -> str | None:
        """The spelling that the word reaches at no cost."""
        live = [self.root]
        for ch in unicodedata.normalize("NFD", word):
            c = TABLE.get(ord(ch), ch)
            if c is not None:
                live = [child for node in live for x in FACES.get(c, c) if (child := node.get(x)) is not None]
                if not live:
                    return None
        return next((node[""] for node in live if "" in node), None)

    def spell(self, word: str) -> str:
        """The word's one spelling."""
        if (s := self.cache.get(word)) is None:
            s = self.follow(word)
            if s is None:
                s, self.missed = unicodedata.normalize("NFD", word).translate(TABLE), self.missed + 1
            else:
                self.found += 1
            if len(self.cache) > _KEPT:
                self.cache.clear()
            self.cache[word] = s
        return s

    def form(self, text: str) -> str:
        """The text's one form."""
        if text.isascii():
            return _CONTROL.sub("", text)
        text = protected(_CONTROL.sub("", text))
        # no word crosses a plain space, so that pieces between them can be remembered
        return unicodedata.normalize("NFC", " ".join([p if p.isascii() else self.pieces.get(p) or self.piece(p) for p in text.split(" ")]))

    def piece(self, text: str) -> str:
        out, at = [], 0
        for m in _WORD.finditer(text):
            if m.start() > at:
                out.append(unicodedata.normalize("NFD", text[at : m.start()]).translate(TABLE))
            word = m[0]
            out.append(word if word.isascii() else self.spell(word))
            at = m.end()
        out.append(unicodedata.normalize("NFD", text[at:]).translate(TABLE))
        done = "".join(out)
        if len(text) <= LONGEST_WORD:
            if len(self.pieces) > _KEPT:
                self.pieces.clear()
            self.pieces[text] = done
        return done


def vocabulary(df: DataFrame, text: str, most: int = MOST_WORDS) -> list[str]:
    """Canonical spellings of the commonest single-script words of all texts, at most ``most``: of the spellings of
    equal classes the commonest, of equally common the first in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces: Counter = Counter()
            for t in b["text"].to_pylist():
                pieces.update(t.split())
            count: Counter = Counter()
            for p, n in pieces.items():
                for w in _LETTERS.findall(p) if p.isascii() else _WORD.findall(p):
                    count[w] += n
            words: Counter = Counter()
            for w, n in count.items():
                if (s := spelling(w)) is not None:
                    words[s] += n
            keys = [s if s.isascii() else classes(s) for s in words]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["k", "s", "n"])

    words = spread(df.select(F.col(text).alias("text")).where(F.col("text").isNotNull())).mapInArrow(run, "k string, s string, n bigint")
    each = words.groupBy("k", "s").agg(F.sum("n").alias("n"))
    best = cut(each.groupBy("k").agg(F.min_by("s", F.struct(-F.col("n"), F.col("s"))).alias("s"), F.sum("n").alias("n")))
    return sorted(commonest(best, "n", most).select("s").toArrow()["s"].to_pylist())


_BUILT: dict[str, Vocabulary] = {}


def _built(token: str, spellings: list[str]) -> Vocabulary:
    """The trie, built once a process."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Vocabulary(spellings)
    return _BUILT[token]


def forms(df: DataFrame, *, id_: str, text: str, words: list[str] | None = None) -> DataFrame:
    """``id, form, text_key`` of every row; a null text has a null form and key.  ``text_key`` is equal for
    equal texts.  Forms are equal for texts that look alike and differ for texts that do not: case, accents,
    digits, raised figures, dashes, line ends, tabs and emoji stay as they are.  Repeated rows each come out;
    empty texts stay empty, and a text of unseen characters only becomes empty.  ``words`` gives canonical
    spellings, else they are those of the texts."""
    spellings = vocabulary(df, text) if words is None else words
    shared, token = df.sparkSession.sparkContext.broadcast(spellings), hashlib.md5("\n".join(spellings).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _built(token, shared.value)
        for b in batches:
            done = [None if t is None else known.form(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(done, pa.string()), b["text_key"]], ["id", "form", "text_key"])

    rows = df.select(F.col(id_).cast("bigint").alias("id"), F.col(text).alias("text"), F.md5(F.col(text).cast("binary")).alias("text_key"))
    return spread(rows).mapInArrow(run, "id bigint, form string, text_key string")


def alike(forms_: DataFrame) -> DataFrame:
    """``id_a, id_b``, smaller first: rows of equal form whose texts are not the same string.

    Pairs are made of different texts first and of their rows then, so that many copies of one text are never
    compared with each other; forms of very many texts, and texts of very many rows, are dealt out in blocks."""
    rows = cut(forms_.where("form IS NOT NULL").select("id", F.md5(F.col("form").cast("binary")).alias("f"), F.col("text_key").alias("t")))
    texts = rows.select("f", "t").distinct()
    several = texts.groupBy("f").agg(F.count("*").alias("k")).where("k > 1").select("f")
    texts = cut(texts.join(several, "f", "left_semi"))
    met = joins.members(joins.within(texts, "f", "t"), "member_a", "member_b", rows, rows, "t", "id")
    return met.select(F.least("member_a", "member_b").alias("id_a"), F.greatest("member_a", "member_b").alias("id_b")).distinct()
