"""Fill-in-middle, token counts and periodic runs against brute force, the tokenizer library and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taskloom.llm import fim, tokens
from taskloom.llm.queries import QUERIES
from taskloom.llm.runs import lyndon, periodic_runs, runs_of

from .conftest import LONG, SF, crc, words
from .test_text_operators import rows

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in middle ---------------------------------------------------------------
def brute_fim(doc_id, text):
    text = text or ""
    h = [int(sha(f"1:{'null' if doc_id is None else doc_id}")[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(text)
    if not n or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


MARKED = [(20, "a <M> b"), (21, "<" * 9), (22, "\0\r\n\U0001f600" * 5), (23, "<P"), (-7, "x"), (2**62, "<S >" * 3), (24, "<<P>"), (20, "a <M> b")]


def test_fill_in_middle(spark, documents, odd):
    marked = spark.createDataFrame(MARKED, "doc_id long, text string")
    for df in (documents, odd, marked):
        done = fim.fill_in_middle(df.withColumn("fim", F.lit("mine")))
        got = rows(done.select(*df.columns, "fim", "fim_", fim.restore(F.col("fim_.output"), F.col("fim_.form")).alias("back")))
        assert len(got) == df.count() and all(r.fim == "mine" for r in got)
        for r in got:
            assert tuple(r.fim_) == brute_fim(r.doc_id, r.text) and r.back == (r.text or "")
    assert {"plain", "psm", "spm"} == {r.form for r in rows(QUERIES["op11_fill_in_middle"](spark, SF))}


def test_fill_in_middle_query(spark, documents, empty):
    got = {r.doc_id: r for r in rows(QUERIES["op11_fill_in_middle"](spark, SF))}
    for d in rows(documents):
        n, form, a, m, output = brute_fim(d.doc_id, d.text)
        assert tuple(got[d.doc_id]) == (d.doc_id, n, form, a, m, sha(output), sha(d.text or ""))
    assert rows(fim.fill_in_middle(empty)) == []


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab \nc", min_size=1, max_size=60), st.integers(0, 60))
def test_units_in_blocks(text, k):
    for unit in (fim.CODE_POINT, r"\S+\s*|\s+"):
        n, after = fim.measure(unit)(text)
        m, at = fim.measure(unit, block=4)(text)
        assert m == n and at(min(k, n)) == after(min(k, n)) and after(n) == len(text)
    assert fim.measure("[abc]")("a b") is None and fim.measure("[abc]", block=1)("a b") is None


def test_units_other(spark):
    df = spark.createDataFrame([(k, f"one  two three{k} four\n") for k in range(40)] + [(99, "?")], "doc_id long, text string")
    done = rows(fim.fill_in_middle(df, rate=100, unit=r"\w+\s*", block=3, markers=("[p]", "[s]", "[m]")))
    for r in done[:40]:
        assert r.fim.n == 4 and r.fim.form != "plain"
        borders = (0, 5, 9, len(r.text) - 5, len(r.text))
        assert r.fim.prefix_chars in borders and r.fim.prefix_chars + r.fim.middle_chars in borders
    assert done[40].fim.n is None and done[40].fim.output == "?"
    for bad in (("<a>", "<a>", "<b>"), ("ab", "bc", "x"), ("", "a", "b"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, markers=bad)
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, unit="a*")


# --- token counts -------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def tables():
    return tokens.Prefixes(tokens.read_vocabulary(VOCABULARY))


def counts(tables, text):
    return [0, *(int(n) for block in tables.blocks(text) for n in block)]


SIGNS = ["a", "B", "'s", "'re", "'", "r", "l", "ve", " ", "\n", "1", "23", "é", "é", "Σ", "中", "한", "<|endoftext|>", "<|", "|>", "..", "!",
         "́", "\x85", "\x1c", "\xa0", "\U0001f600", "ǅ", "the", "ing", "tion", "İ", "ﷺ", "aaaa", "ো", "\0", "\x7f", "　", "K", "x" * 40]


def test_every_prefix(tables, library):
    random.seed(5)
    for _ in range(400):
        text = "".join(random.choice(SIGNS) for _ in range(random.randint(0, 9)))
        assert counts(tables, text) == [library(text[:k]) for k in range(len(text) + 1)], ascii(text)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=12))
def test_every_prefix_of_any_text(tables, library, text):
    assert counts(tables, text) == [library(text[:k]) for k in range(len(text) + 1)]


def test_long_words_and_blocks(tables, library, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    monkeypatch.setattr(tokens, "KNOWN", 50)
    for text in ("aab" * 3000, LONG[:5000], "word\U0001f600 " * 300, "中文" * 500, "<|endoftext|> it's " * 40):
        got = counts(tables, text)
        assert got[-1] == library(text) and all(got[k] == library(text[:k]) for k in range(0, len(text), 97))


def test_token_counts(spark, documents, odd, empty, library):
    got = {r.doc_id: r for r in rows(QUERIES["op12_token_counts"](spark, SF))}
    for d in rows(documents):
        n, size = library(d.text or ""), len((d.text or "").encode())
        assert tuple(got[d.doc_id])[:4] == (d.doc_id, size, n, n > 2048)
    done = rows(tokens.token_counts(odd.withColumn("tokens", F.lit(1)), VOCABULARY, limit=7))
    assert len(done) == odd.count()
    for r in done:
        text = r.text or ""
        assert r.tokens == 1 and r.tokens_.n_tokens == library(text) and r.tokens_.over_limit == (library(text) > 7)
        assert r.tokens_.fits == max(k for k in range(min(len(text), 200) + 1) if library(text[:k]) <= 7)
    assert rows(tokens.token_counts(empty, VOCABULARY)) == []


def test_stored_prefixes(spark, odd, empty, library):
    long = "the prefix of a text " * 900
    docs = odd.where("doc_id <> 5").select("doc_id", "text", "a").unionByName(spark.createDataFrame([(30, long, "x")], "doc_id long, text string, a string"))
    table = tokens.prefix_table(docs, VOCABULARY).cache()
    text = {r.doc_id: r.text or "" for r in rows(docs)}
    asked = spark.createDataFrame([(i, k) for i in text for k in (-1, 0, 1, 7, 4096, 4097, 9000, 10**9)], "doc_id long, chars long")
    got = rows(tokens.count_at(table, asked))
    assert len(got) == len(text) * 8
    for r in got:
        assert r.n_tokens == library(text[r.doc_id][:max(r.chars, 0)])
    for budget in (0, 5, 3000):
        for r in rows(tokens.within_budget(table, budget)):
            t = text[r.doc_id]
            assert library(t[:r.chars]) <= budget and (r.chars == len(t) or library(t[:r.chars + 1]) > budget)
    assert rows(tokens.prefix_table(empty, VOCABULARY)) == []


def test_other_tokenizers_are_refused(spark, documents):
    with pytest.raises(ValueError):
        tokens.Prefixes(tokens.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


# --- periodic runs --------------------------------------------------------------------
def brute_lyndon(s):
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[i + k:j] for k in range(1, j - i))) for i in range(len(s))]


def brute_runs(s, least=6, exponent=4):
    found = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q):
                part = s[i:i + size]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_lyndon_arrays(s):
    s = [sorted(set(s)).index(x) for x in s]
    top = max(s)
    assert lyndon(s, top + 1).tolist() == brute_lyndon(s)
    assert lyndon([top - x for x in s], top + 1).tolist() == brute_lyndon([top - x for x in s])


def repetitive(seed):
    rng = random.Random(seed)
    s = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.randrange(rng.randint(1, 5)) for _ in range(rng.randint(1, 7))]
        s += unit * rng.randint(1, 8) + unit[:rng.randint(0, len(unit))]
    return s


def test_runs_against_brute_force():
    for seed in range(600):
        s = repetitive(seed)
        assert runs_of(np.array(s)) == brute_runs(s), s
        assert runs_of(np.array(s), 9, 5) == brute_runs(s, 9, 5), s


def collapsed(ws, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def test_runs_of_long_texts():
    assert runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert runs_of(np.arange(60_000) % 9_000) == [(0, 60_000, 9_000)]
    assert runs_of(np.arange(100_000)) == []
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert runs_of(np.array(b)) == []  # powers in a Fibonacci word stay below four


def test_periodic_runs(spark, odd, empty):
    extra = [(40 + k, " ".join(f"w{x}" for x in repetitive(k)), "x") for k in range(30)] + [(5, "a b\t a\nb a b a b", "x"), (None, "z " * 9, "x")]
    for df in (odd, spark.createDataFrame(extra, "doc_id long, text string, periodic string")):
        name = "periodic_" if "periodic" in df.columns else "periodic"
        got = rows(periodic_runs(df))
        assert len(got) == df.count()
        for r in got:
            ws = words(r.text)
            found = brute_runs(ws) if len(ws) < 1000 else []
            assert [tuple(x) for x in r[name].runs] == found and r[name].n_words == len(ws)
            assert r[name].collapsed == collapsed(ws, found)
    assert rows(periodic_runs(empty)) == []
    with pytest.raises(ValueError):
        periodic_runs(odd, exponent=3)


def test_periodic_runs_query(spark, documents):
    got = {r.doc_id: r for r in rows(QUERIES["op13_periodic_runs"](spark, SF))}
    seen = 0
    for d in rows(documents):
        ws = words(d.text)
        n, h = len(ws), crc(d.doc_id)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        found = brute_runs(ws)
        seen += len(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        expected = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        assert tuple(got[d.doc_id]) == (d.doc_id, len(found), *expected, sha(lines), sha(collapsed(ws, found)))
    assert seen
