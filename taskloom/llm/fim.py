"""Fill-in-middle rewriting by repeated captures (operator 11).

One ``fullmatch`` of ``(unit)*`` retains every repetition of the group, so
``match.ends(1)`` holds their number n and the offset after each: both cuts are
two look-ups. A text of more than ``BLOCK`` units is matched block by block
(``(unit){0,BLOCK}``) and only the blocks that hold a cut are matched again, so
the captures of a task stay bounded. Units are taken greedily, without giving
back.

Where to cut, and which form a document takes, depends on a hash of the seed
and the id alone: reruns and other partitionings agree. A text that holds a
marker stays plain, so every output can be taken apart again (``restore``).

Defined results: a null text counts as empty and stays plain; a null id hashes
as the word ``null``; repeated rows get equal results; a text that the unit does
not tile stays plain, with n null; an empty table gives no rows; all columns of
the input are kept, the result is one struct column under a free name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm.columns import free_name, whole_text

#: What precedes the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
CODE_POINT = "(?s:.)"
BLOCK = 1 << 20
RESULT = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"
KIND = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def measure(unit: str, block: int = BLOCK) -> Callable[[str], tuple[int, Callable[[int], int]] | None]:
    """Function of a text: (number of units, offset after k units), or None if the unit does not tile the text."""
    whole, part = regex.compile(f"({unit})*+"), regex.compile(f"({unit}){{0,{block}}}+")
    if whole.fullmatch("").ends(1) or regex.fullmatch(unit, ""):
        raise ValueError("the unit must not match the empty text")

    def by_blocks(text: str):
        begin, upto = [0], [0]
        while begin[-1] < len(text):
            ends = part.match(text, begin[-1]).ends(1)
            if not ends:
                return None
            begin.append(ends[-1])
            upto.append(upto[-1] + len(ends))

        def after(k: int) -> int:
            if not k:
                return 0
            at = bisect_left(upto, k) - 1
            return part.match(text, begin[at]).ends(1)[k - upto[at] - 1]

        return upto[-1], after

    def of(text: str):
        if len(text) > block:
            return by_blocks(text)
        match = whole.fullmatch(text)
        if match is None:
            return None
        ends = match.ends(1)
        return len(ends), lambda k: ends[k - 1] if k else 0

    return of


def draws(seed: int, ident) -> list[int]:
    """First four 32-bit numbers of the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'null' if ident is None else ident}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def rewrite(text: str, ident, of, seed: int, rate: int, suffix_first: int, markers) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    found = of(text)
    n, after = found or (None, None)
    h = draws(seed, ident)
    if not n or h[2] % 100 >= rate or any(m in text for m in markers):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = after(low), after(high)
    head, mid, tail = text[:a], text[a:b], text[b:]
    p, s, m = markers
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((s, tail, p, head, m, mid))
    return n, "psm", a, b - a, "".join((p, head, s, tail, m, mid))


def separable(markers) -> None:
    """Markers must differ and never overlap each other, so that an output splits in one way only."""
    for i, x in enumerate(markers):
        for j, y in enumerate(markers):
            if not x or (i != j and x in y) or any(x.endswith(y[:k]) for k in range(1, len(y))):
                raise ValueError(f"markers {x!r} and {y!r} overlap")


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, suffix_first: int = 20, unit: str = CODE_POINT,
                   markers: tuple[str, str, str] = MARKERS, into: str = "fim", block: int = BLOCK) -> DataFrame:
    """docs with a struct (n, form, prefix_chars, middle_chars, output) in column ``into``.

    ``rate`` percent of the documents are rearranged, ``suffix_first`` percent
    of those with the suffix before the prefix. ``unit`` is the regular
    expression of what may not be cut: a code point, a word with its blanks, a
    line. Lengths of prefix and middle are in code points, n is in units.
    """
    separable(markers)
    measure(unit, block)  # reports a bad unit here, not in a task

    @F.arrow_udf(RESULT)
    def rearrange(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        of = measure(unit, block)
        for texts, idents in batches:
            done = [rewrite(t.as_py(), i, of, seed, rate, suffix_first, markers) for t, i in zip(texts, idents.to_pylist())]
            columns = list(zip(*done)) if done else [()] * 5
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KIND)], fields=list(KIND))

    return docs.withColumn(free_name(docs, into), rearrange(whole_text(), F.col("doc_id")))


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of, from the output and its form alone; null if a marker is missing."""
    part = F.split(output, "|".join(re.sub(r"(\W)", r"\\\1", m) for m in markers))
    at = lambda k: F.get(part, F.lit(k))
    return (F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1)))
            .otherwise(output))
