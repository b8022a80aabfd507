"""Exact token counts of every prefix by dynamic programming (operator 12).

For byte-pair tokenizers with word ends (lower case, white space dropped). The
tokens of a prefix are those of the prefix without its last token, plus that
token: of all tokens that end there, exactly one stands validly beside the last
token of the shorter prefix. Two tokens are valid neighbours if no pair of parts
that face each other while the merges run would have been merged across the
border. One pass over a word thus gives the count of each of its prefixes, and
sums over the words give it for the text: how many tokens a cut text has, and
the longest prefix within a budget, are look-ups; nothing is encoded again.

A prefix is closed (its last sign carries the word end), so counts are not
monotone: ``fits`` is the longest prefix that fits, wherever shorter ones do not.
Prefixes are counted in code points of the text as given, whatever normalising
does to it. Classes and lower case of signs are asked from the tokenizer, once
for each.

The words of a slice of texts that are not known yet go through the program side
by side: one step looks up all of their parts of one length at once, in tables
keyed by 64-bit hashes of up to 32 bytes.

The tokenizer file is read on the driver and travels to the tasks (its size is
checked, ``FILE_BOUND``); no tokenizer is trained or copied. Words known so far
are kept per task, ``KNOWN`` at most. Texts are worked off in blocks of about
``BLOCK`` code points that end at white space.

Defined results: a null text counts as empty and has no tokens; ids are passed
through; repeated rows get equal results; an empty table gives no rows; all
columns of the input are kept by ``token_counts``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm.columns import free_name, whole_text
from taskloom.llm.words import BASE, slices

FILE_BOUND = 32 << 20
KNOWN = 1 << 18
BLOCK = 1 << 18
#: Prefixes in a row of the prefix table.
ROW = 4096
#: How tokenizers of this kind split normalised text, and the mark of a word's end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
RESULT = "struct<n_bytes:bigint,n_tokens:bigint,over_limit:boolean,fits:bigint>"

#: SPLIT over the classes of signs. A space behind a piece goes with it; other white space is kept as a piece of its own.
PIECES = re.compile(r"(?:'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+) ?|\s+", re.ASCII)
SHORTENED = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Table:
    """Numbers by 64-bit key, asked for whole arrays of keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = (4 * len(keys) + 1).bit_length()
        self.key, self.value = np.full(1 << self.bits, FREE), np.zeros(1 << self.bits, np.int32)
        todo, slot = np.arange(len(keys)), self.slots(keys)
        while len(todo):
            free = self.key[slot[todo]] == FREE
            at, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.key[at], self.value[at] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * BASE >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 if it has none."""
        slot = self.slots(keys)
        held = self.key[slot]
        out = np.where(held == keys, self.value[slot], -1)
        todo = np.flatnonzero((held != keys) & (held != FREE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.key) - 1)
            held = self.key[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.value[slot[todo[hit]]]
            todo = todo[~hit & (held != FREE)]
        return out


FREE = np.uint64(2**64 - 1)
#: Words of up to this many bytes are worked off together.
SHORT = 48
#: Logarithm of the number of token pairs whose verdict is remembered.
VERDICT_BITS = 20


class Merges:
    """Tokens by number, and which of them may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        number = {t: k for k, t in enumerate(vocab)}
        n = len(number)
        self.shift = np.uint64(n.bit_length())
        # when each token arises, and from which halves; single signs are there from the start
        self.born, self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        pairs = np.array([(number[a], number[b], number[a + b]) for a, b in merges]).reshape(-1, 3)
        self.rank = Table(self.pair(pairs[:, 0], pairs[:, 1]), np.arange(1, len(pairs) + 1))
        for r in range(len(pairs), 0, -1):
            a, b, made = pairs[r - 1]
            self.born[made], self.left[made], self.right[made] = r, a, b
        self.known, self.verdict = np.full(1 << VERDICT_BITS, FREE), np.zeros(1 << VERDICT_BITS, bool)
        # a token whose own signs would be merged otherwise never appears
        made = np.flatnonzero(self.born)
        made = made[np.argsort(self.born[made])]
        crossed = np.zeros(n, bool)
        crossed[made] = self.crossed(self.left[made], self.right[made], self.born[made])
        for k in made.tolist():
            crossed[k] |= crossed[self.left[k]] | crossed[self.right[k]]
        sign = {c: b for b, c in enumerate(byte_signs())}
        tokens = [(bytes(sign[c] for c in t.removesuffix(END)), k, t.endswith(END)) for t, k in number.items() if not crossed[k]]
        #: tokens inside a word, and those that end one, by their bytes
        self.opened = {t: k for t, k, ends in tokens if not ends}
        self.closed = {t: k for t, k, ends in tokens if ends}
        self.longest = max(len(t) for t, _, _ in tokens)
        self.tables = [Table(np.array([spelled(t) for t in d], np.uint64), np.array(list(d.values()))) for d in (self.opened, self.closed)]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) << self.shift | b.astype(np.uint64)

    def crossed(self, a: np.ndarray, b: np.ndarray, made: np.ndarray | None = None) -> np.ndarray:
        """Whether a merge would cross the border of tokens a and b. ``made``: when they are meant to be merged themselves."""
        never = len(self.known) + len(self.born)
        out, todo = np.zeros(len(a), bool), np.arange(len(a))
        ends_a = np.full(len(a), never) if made is None else made
        ends_b, own = ends_a, made is not None
        while len(todo):
            r = self.rank.find(self.pair(a, b)).astype(np.int64)
            # of equal merges the leftmost comes first
            bad = (r >= 0) & (r < ends_a) & (r <= ends_b) & (not own)
            own = False
            out[todo[bad]] = True
            at_a, at_b = self.born[a], self.born[b]
            go = ~bad & ((at_a > 0) | (at_b > 0))
            # step back in time: take apart the half that arose last
            of_a = at_a > at_b
            ends_a, ends_b = np.where(of_a, at_a, ends_a)[go], np.where(of_a, ends_b, at_b)[go]
            a, b = np.where(of_a, self.right[a], a)[go], np.where(of_a, b, self.left[b])[go]
            todo = todo[go]
        return out

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which tokens a may stand before the tokens b."""
        pair = self.pair(a, b)
        with np.errstate(over="ignore"):
            slot = (pair * BASE >> np.uint64(64 - VERDICT_BITS)).astype(np.int64)
        new = np.flatnonzero(self.known[slot] != pair)
        ok = self.verdict[slot]
        if len(new):
            ok[new] = ~self.crossed(a[new], b[new])
            self.verdict[slot[new]] = False
            self.known[slot[new]], self.verdict[slot[new]] = pair[new], ok[new]
        return ok

    def prefixes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For words of up to SHORT bytes: the numbers of tokens of their closed prefixes, one after another, and how many each word has.

        Prefixes end with a code point; the last number of each word stands there twice.
        """
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        most = int(size.max())
        signs = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in (words[k] for k in order)), np.uint8).reshape(len(words), most).T
        here = np.searchsorted(-size[order], -np.arange(most + 1), side="right")  # words that reach each length
        hashes, power = np.zeros((most + 1, len(words)), np.uint64), np.ones(most + 1, np.uint64)
        # by length of the open prefix: its last token and its number of tokens
        last, count = np.zeros((most + 1, len(words)), np.int64), np.zeros((most + 1, len(words)), np.int32)
        out = np.zeros((most + 1, len(words)), np.int32)
        with np.errstate(over="ignore"):
            power[1:] = BASE
            power = np.cumprod(power)
            for i in range(1, most + 1):
                hashes[i] = hashes[i - 1] * BASE + (signs[i - 1].astype(np.uint64) + np.uint64(1))
                for table, inside in zip(self.tables, (True, False)):
                    todo = np.arange(here[i])
                    for j in range(max(0, i - self.longest), i):
                        token = table.find(hashes[i, todo] - hashes[j, todo] * power[i - j])
                        fits = token >= 0
                        if j:
                            some = np.flatnonzero(fits)
                            fits[some] = self.beside(last[j, todo[some]], token[some])
                        done = todo[fits]
                        if inside:
                            last[i, done], count[i, done] = token[fits], count[j, done] + 1
                        else:
                            out[i, done] = count[j, done] + 1
                        todo = todo[~fits]
                        if not len(todo):
                            break
        back = np.empty(out.T.shape, out.dtype)
        back[order] = out.T
        # a prefix may end where no continuation byte follows
        follows = np.zeros((len(words), most + 1), bool)
        follows[order, 1:] = (signs.T & 0xC0) == 0x80
        stops = (np.arange(1, most + 1) <= size[:, None]) & ~np.concatenate([follows[:, 2:], np.zeros((len(words), 1), bool)], axis=1)
        kept = np.concatenate([back[:, 1:], back[np.arange(len(words)), size][:, None]], axis=1)
        mask = np.concatenate([stops, np.ones((len(words), 1), bool)], axis=1)
        return kept[mask], stops.sum(axis=1)

    def prefixes_of_one(self, word: bytes, stops: set[int]) -> list[int]:
        """The same for a single word of any length, at the lengths in ``stops``."""
        last, count, out, seen = [0], [0], [], {}

        def fits(j: int, token: int) -> bool:
            if not j:
                return True
            pair = (last[j], token)
            if pair not in seen:
                if len(seen) > KNOWN:
                    seen.clear()
                seen[pair] = bool(self.beside(np.array(pair[:1]), np.array(pair[1:]))[0])
            return seen[pair]

        for i in range(1, len(word) + 1):
            starts = range(max(0, i - self.longest), i)
            for j in starts:
                token = self.opened.get(word[j:i])
                if token is not None and fits(j, token):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            if i in stops:
                for j in starts:
                    token = self.closed.get(word[j:i])
                    if token is not None and fits(j, token):
                        out.append(count[j] + 1)
                        break
        return out


def spelled(token: bytes) -> int:
    """The hash that ``Merges.prefixes`` gives these bytes."""
    h = 0
    for c in token:
        h = (h * int(BASE) + c + 1) % 2**64
    return h


class Ask(dict):
    """Table of single signs, filled by asking."""

    def __init__(self, answer):
        super().__init__()
        self.answer = answer

    def __missing__(self, code: int) -> str:
        self[code] = value = self.answer(chr(code))
        return value


class Prefixes:
    """Counts of all prefixes of texts, by one tokenizer file."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import NFC

        spec = json.loads(source)
        check_kind(spec)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = [t["content"] for t in spec["added_tokens"]]
        self.merges = Merges(model["vocab"], pairs)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        tokenizer = Tokenizer.from_str(source)
        self.composed = NFC().normalize_str
        lower, pieces = tokenizer.normalizer.normalize_str, lambda s: len(tokenizer.pre_tokenizer.pre_tokenize_str(s))

        def kind(c: str) -> str:
            alone = pieces(f"a{c}a")
            return "q" if alone == 1 else "\t" if alone == 2 else "!" if pieces(f"!{c}!") == 1 else "0"

        # white space is left as it is: it only ends pieces
        self.lower = Ask(lambda c: lower(c) if not c.isspace() else c)
        self.kind = Ask(lambda c: c if c.isascii() else kind(c))
        self.ready: dict[str, list[str]] = {}
        self.forget()

    # --- words -------------------------------------------------------------
    def learn(self, pieces: set[str]) -> None:
        """Counts of the prefixes of pieces, in code points."""
        # a piece with a space behind it shares the numbers of the one without
        blank = lambda p: self.kind[ord(p[0])] in " \t\n\r\f\v"
        plain = {p[:-1] if p[-1] == " " and not blank(p) else p for p in pieces}.difference(self.place)
        cut = [p for p in plain if p in SHORTENED]
        if cut:  # cut short, these are a quote and a letter
            plain.update({"'", *(p[1] for p in cut if len(p) == 3)}.difference(self.place))
        white = [p for p in plain if blank(p)]
        for p in white:
            self.keep([p], np.zeros(len(p) + 1, np.int32), np.array([len(p)]))
        words = [(p, p.encode()) for p in plain.difference(white)]
        short = [x for x in words if len(x[1]) <= SHORT]
        for at in range(0, len(short), KNOWN // 8):
            part = short[at:at + KNOWN // 8]
            self.keep([p for p, _ in part], *self.merges.prefixes([w for _, w in part]))
        for p, w in words:
            if len(w) > SHORT:
                counts = self.merges.prefixes_of_one(w, set(ends_of(p)))
                self.keep([p], np.array([*counts, counts[-1]]), np.array([len(p)]))
        for p in cut:
            quote, at = self.counts_of("'")[0], self.begin[self.place[p]]
            self.flat[at] = quote
            if len(p) == 3:
                self.flat[at + 1] = quote + self.counts_of(p[1])[0]
        spaced = [p for p in pieces if p not in self.place]
        if spaced:
            base = np.array([self.place[p[:-1]] for p in spaced])
            self.entries(spaced, self.begin[base], self.length[base] + 1, self.total[base])

    def counts_of(self, piece: str) -> np.ndarray:
        at = self.begin[self.place[piece]]
        return self.flat[at:at + len(piece)]

    def keep(self, pieces: list[str], counts: np.ndarray, length: np.ndarray) -> None:
        """Pieces of ``length`` code points whose numbers follow each other in ``counts``, each with one more at its end."""
        if not pieces:
            return
        self.flat = fitted(self.flat, self.used + len(counts))
        self.flat[self.used:self.used + len(counts)] = counts
        end = self.used + np.cumsum(length + 1)
        self.entries(pieces, end - length - 1, length, self.flat[end - 1])
        self.used += len(counts)

    def entries(self, pieces: list[str], begin: np.ndarray, length: np.ndarray, total: np.ndarray) -> None:
        n = len(self.place)
        for name, values in (("begin", begin), ("length", length), ("total", total)):
            setattr(self, name, fitted(getattr(self, name), n + len(pieces)))
            getattr(self, name)[n:n + len(pieces)] = values
        self.place.update(zip(pieces, range(n, n + len(pieces))))

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.begin, self.length, self.total = (np.zeros(1 << 12, np.int64) for _ in range(3))

    # --- texts -------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """Pieces of a normalised text, white space included."""
        if text.isascii():
            return PIECES.findall(text)
        kinds = PIECES.findall(text.translate(self.kind))
        at = np.cumsum([0, *map(len, kinds)]).tolist()
        return [text[a:b] for a, b in zip(at, at[1:])]

    def prepare(self, texts: list[str]) -> None:
        """Learn the words of many texts together; their counts are then only put together."""
        self.ready = {}
        if len(self.place) > KNOWN:
            self.forget()
        new: set[str] = set()
        for text in texts:
            for block in self.cut(text):
                if self.special and self.special.search(block):
                    continue
                if not block.isascii() and self.composed(block) != block:
                    continue
                self.ready[block] = pieces = self.pieces(block.lower() if block.isascii() else block.translate(self.lower))
                new.update(set(pieces).difference(self.place))
        self.learn(new)

    def ordinary(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text without special strings, the empty one included."""
        pieces = self.ready.get(text)
        if pieces is None and text.isascii():
            return self.normalised(text.lower())
        if pieces is None and self.composed(text) != text:
            return self.decomposed(text)
        counts = self.normalised(text.translate(self.lower)) if pieces is None else self.joined(pieces)
        if len(counts) == len(text) + 1:
            return counts
        return counts[np.cumsum([0, *(len(self.lower[ord(c)]) for c in text)])]

    def normalised(self, text: str) -> np.ndarray:
        pieces = self.pieces(text)
        new = set(pieces).difference(self.place)
        if new:
            self.learn(new)
        return self.joined(pieces)

    def joined(self, pieces: list[str]) -> np.ndarray:
        which = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        length, total = self.length[which], self.total[which]
        end = np.cumsum(length)
        out = np.zeros((int(end[-1]) if len(end) else 0) + 1, np.int64)
        out[1:] = self.flat[np.arange(len(out) - 1) + np.repeat(self.begin[which] - (end - length), length)]
        out[1:] += np.repeat(np.cumsum(total) - total, length)
        return out

    def decomposed(self, text: str) -> np.ndarray:
        """The same for a text that composing changes: a prefix may end inside what is composed."""
        import unicodedata

        def joins(c: str) -> bool:
            return unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ"

        heads = [k for k, c in enumerate(text) if k == 0 or not joins(c)] + [len(text)]
        parts = [self.composed(text[a:b]).translate(self.lower) for a, b in zip(heads, heads[1:])]
        whole = "".join(parts)
        counts = self.normalised(whole)
        borders = np.cumsum([0, *map(len, self.pieces(whole))])
        out, at = np.zeros(len(text) + 1, np.int64), 0
        for a, b, part in zip(heads, heads[1:], parts):
            for k in range(a + 1, b):
                # far enough back, the pieces of the cut text are those of the whole
                back = borders[max(0, int(np.searchsorted(borders, at)) - 4)]
                out[k] = counts[back] + self.normalised(whole[back:at] + self.composed(text[a:k]).translate(self.lower))[-1]
            at += len(part)
            out[b] = counts[at]
        return out

    def cut(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            to = at + BLOCK
            gap = WHITE.search(text, to) if to < len(text) else None
            to = gap.start() if gap else len(text)
            yield text[at:to]
            at = to

    def blocks(self, text: str) -> Iterator[np.ndarray]:
        """Counts of the prefixes of 1, 2, ... code points, block by block."""
        done = 0
        for block in self.cut(text):
            counts = self.with_special(block)
            yield counts[1:] + done
            done += int(counts[-1])

    def each(self, texts: pa.Array) -> Iterator[Iterator[np.ndarray]]:
        """``blocks`` of every text of a column, in slices whose words are learnt together."""
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
            here = part.column(0).to_pylist()
            self.prepare(here)
            yield from map(self.blocks, here)

    def with_special(self, text: str) -> np.ndarray:
        parts, at, done = [np.zeros(1, np.int64)], 0, 0
        for m in self.special.finditer(text) if self.special else ():
            # cut short, a special string is ordinary text that joins what stands before it
            counts = self.ordinary(text[at:m.end() - 1])
            parts.append(counts[1:] + done)
            done += int(counts[m.start() - at]) + 1
            parts.append(np.array([done]))
            at = m.end()
        parts.append(self.ordinary(text[at:])[1:] + done)
        return np.concatenate(parts)


#: White space at which a text may be cut into blocks.
WHITE = re.compile(r"[ \t\n\r]")


def fitted(values: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer one that begins with it."""
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n, 2 * len(values)) - len(values), values.dtype)])


def ends_of(piece: str) -> list[int]:
    """Bytes up to the end of each code point."""
    return np.cumsum([len(c.encode()) for c in piece]).tolist()


def check_kind(spec: dict) -> None:
    """Refuse tokenizer files that this method does not fit."""
    steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    model = spec["model"]
    fits = (steps == ["NFC", "Replace", "Lowercase"] and (first.get("pattern") or {}).get("Regex") == SPLIT and model["type"] == "BPE"
            and model.get("end_of_word_suffix") == END and not model.get("dropout") and not model.get("ignore_merges")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]))
    if not fits:
        raise ValueError("not a lower-casing byte-pair tokenizer with word ends")


def read_vocabulary(path: str) -> str:
    if os.path.getsize(path) > FILE_BOUND:
        raise ValueError(f"{path} has more than {FILE_BOUND} bytes")
    with open(path, encoding="utf-8") as f:
        return f.read()


_LOADED: dict[int, Prefixes] = {}


def loaded(source) -> Prefixes:
    """The tables of a broadcast file, built once in a worker process."""
    key = hash(source.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Prefixes(source.value)
    return _LOADED[key]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, into: str = "tokens") -> DataFrame:
    """docs with a struct (n_bytes, n_tokens, over_limit, fits) in column ``into``.

    ``fits`` is the length in code points of the longest prefix with at most ``limit`` tokens.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("struct<n_tokens:bigint,fits:bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = loaded(source)
        for texts in batches:
            n, fits = [], []
            for parts in tables.each(texts):
                at, best, last = 0, 0, 0
                for counts in parts:
                    within = np.flatnonzero(counts <= limit)
                    best = at + int(within[-1]) + 1 if len(within) else best
                    at, last = at + len(counts), int(counts[-1])
                n.append(last)
                fits.append(best)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(fits, pa.int64())], names=["n_tokens", "fits"])

    name = free_name(docs, into)
    done = docs.withColumn(name, count(whole_text()))
    found = F.col(f"`{name}`")
    return done.withColumn(name, F.struct(F.octet_length(whole_text()).cast("long").alias("n_bytes"), found["n_tokens"].alias("n_tokens"),
                                          (found["n_tokens"] > limit).alias("over_limit"), found["fits"].alias("fits")))


def prefix_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, row, counts): the counts of the prefixes row * ROW + 1, ... of every text, to be stored and asked.

    A text without code points has one row with no counts. Ids should be unique; repeated ids have rows of all their texts.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = loaded(source)

        def batch(made):
            ids, numbers, counts = zip(*made)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(counts, pa.list_(pa.int32()))],
                                              names=["doc_id", "row", "counts"])

        for b in batches:
            for ident, parts in zip(b.column(0).to_pylist(), tables.each(b.column(1))):
                number, rest = 0, np.zeros(0, np.int32)
                for counts in parts:
                    rest = np.concatenate([rest, counts.astype(np.int32)])
                    full = len(rest) // ROW
                    if full:
                        yield batch([(ident, number + k, rest[k * ROW:(k + 1) * ROW]) for k in range(full)])
                    number, rest = number + full, rest[full * ROW:]
                if len(rest) or not number:
                    yield batch([(ident, number, rest)])

    slim = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return slim.mapInArrow(rows, "doc_id long, row long, counts array<int>")


def count_at(table: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc_id, chars, ...) with ``n_tokens``: the count of the prefix of ``chars`` code points (the whole text, if that is shorter)."""
    ends = table.groupBy("doc_id").agg(F.max(F.struct("row", F.size("counts").alias("size"))).alias("end"))
    length = F.col("end.row") * ROW + F.col("end.size")
    placed = asked.join(ends, "doc_id").withColumn("_at", F.least(F.col("chars").cast("long"), length)).drop("end")
    placed = placed.withColumn("row", F.expr(f"greatest(_at - 1, 0L) div {ROW}"))
    met = placed.join(table, ["doc_id", "row"])
    value = F.get("counts", (F.col("_at") - 1 - F.col("row") * ROW).cast("int"))
    return met.withColumn("n_tokens", F.when(F.col("_at") <= 0, 0).otherwise(value).cast("long")).drop("row", "counts", "_at")


def within_budget(table: DataFrame, budget: Column | int) -> DataFrame:
    """(doc_id, chars): the longest prefix of every text with at most ``budget`` tokens, by a partial aggregate over its rows."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    at = F.array_max(F.transform("counts", lambda n, k: F.when(n <= budget, k + 1)))
    return table.groupBy("doc_id").agg(F.coalesce(F.max(F.col("row") * ROW + at), F.lit(0)).cast("long").alias("chars"))
