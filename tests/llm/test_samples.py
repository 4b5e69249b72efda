"""Fill-in-the-middle samples, spelling variants and packing against plain loops."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changelens.llm import fill_in_middle, packing, spelling

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SPEC = open(PATH, encoding="utf-8").read()


# Fill in the middle


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=400))
def test_wavelet_ranks(codes):
    matrix = fill_in_middle.WaveletMatrix(np.array(codes, np.uint8))
    at = np.arange(len(codes) + 1)
    for c in range(5):
        assert matrix.rank(c, at).tolist() == [codes[:i].count(c) for i in at]
    every = np.arange(len(codes) + 2)
    found = matrix.after((1, 3), every, np.zeros_like(every), np.full_like(every, len(codes)))
    ends = [i + 1 for i, c in enumerate(codes) if c in (1, 3)]
    assert found.tolist() == [0 if k == 0 else ends[k - 1] if k <= len(ends) else len(codes) for k in every]


PIECES = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "word": r"[^ \t-\r]*[ \t-\r]|[^ \t-\r]+"}


def plain_middle(d, text, unit="line", percent=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'null' if d is None else d}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(PIECES[unit], text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (d, n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (d, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (d, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = ["<", "a<S\nP>b\n<", "x <M> y", "é\n日本\n\n😀. b! c", "\n", "\n\n\n", "no end\nlast", "<P", "S>\n<M\n>"]


@pytest.mark.parametrize("unit", ["line", "sentence", "word"])
def test_middles(spark, awkward, empty, unit):
    extra = spark.createDataFrame([(100 + i, ODD[i % len(ODD)]) for i in range(90)], "doc_id bigint, text string")
    for frame in (awkward, extra):
        made = fill_in_middle.filled_in_middle(frame, unit=unit)
        rows = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()]
        assert collections.Counter(rows) == collections.Counter(plain_middle(r.doc_id, r.text, unit) for r in frame.collect())
        back = made.select(fill_in_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
        assert collections.Counter(r.t for r in back) == collections.Counter(r.text or "" for r in frame.collect())
    assert fill_in_middle.filled_in_middle(empty).collect() == []


def test_shares_of_forms(corpus):
    rows = fill_in_middle.filled_in_middle(corpus, percent=60, spm_percent=30).collect()
    assert [tuple(r) for r in rows] == [plain_middle(r.doc_id, r.text, percent=60, spm=30) for r in corpus.collect()]
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


# Spelling variants


def plain_words(rows, slips=97, least_length=5, least_count=3):
    total = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if slips and h % slips == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if abs(len(w) - len(v)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def test_edits_share_a_signature():
    rnd = random.Random(2)
    for _ in range(300):
        word = "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(5, 14)))
        k, kind = rnd.randrange(len(word)), rnd.randrange(2)
        other = word[:k] + ("x" if kind else "") + word[k + 1 :]
        if len(other) < 5:
            continue
        who, sign, around = spelling.signatures([word, other])
        held = [{(s, *x) for w, s, *x in zip(who, sign, *around) if w == i} for i in (0, 1)]
        assert {x[0] for x in held[0]} & {x[0] for x in held[1]}
        split = [{(x[0], k, y) for x in h for k, y in enumerate(x[1:])} for h in held]
        assert split[0] & split[1]


@pytest.mark.parametrize("bucket", [1, 16])
def test_near_pairs(spark, bucket):
    """Few letters, so that many words share their multiset, and a hot group of words with one letter changed."""
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))) for _ in range(250)} | {f"pref{c}xend" for c in "abcdefghijklmnopqrstuvw"}
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n bigint")
    n = {w: i for i, w in enumerate(sorted(words))}
    rows = spelling.near_pairs(frame, bucket=bucket).collect()
    made = {(r.a, r.b) for r in rows}
    assert len(rows) == len(made) and all((r.n_a, r.n_b) == (n[r.a], n[r.b]) for r in rows)
    assert made == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_variants(spark, awkward, empty):
    rnd = random.Random(3)
    vocabulary = ["straße", "ÀVOIR", "Houses", "letter", "spelling", "Ünter", "naïve", "colour", "abcde"]
    rows = []
    for i in range(400):
        words = [rnd.choice(vocabulary) for _ in range(30)]
        if i % 3 == 0:
            w = rnd.choice(words)
            k = rnd.randrange(len(w))
            words[0] = w[:k] + rnd.choice(["", "x", "é", w[k] * 2]) + w[k + 1 :]
        rows.append((None if i == 7 else i // 2, " ".join(words) + ("1" if i % 2 else "")))
    rows.append((None, None))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = spelling.spelling_variants(frame).collect()
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in made} == plain_variants(plain_words(rows)) and len(made) > 10
    assert any(r.form for r in made)
    texts = [(r.doc_id, r.text) for r in awkward.collect()]
    made = spelling.spelling_variants(awkward).collect()
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in made} == plain_variants(plain_words(texts))
    assert spelling.spelling_variants(empty).collect() == []


def test_roots_of_long_chains(spark):
    """Powers of two, so that every word of the chain has the next as its form; ties go to the smallest."""
    frame = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [("x", "w005")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(frame).collect()} == {**{f"w{i:03}": "w037" for i in range(37)}, "x": "w037"}


# Packing


def library_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabte'sd123 .,!\n\t\r\x0b\x1c\x85   é日😀<|endoftext|>"), max_size=60))
def test_ids_equal_the_library(text):
    assert ENCODER.encode(text).tolist() == library_ids(text)[:-1]


ENCODER = packing.Encoder(SPEC)


def plain_best_fit(lengths, window):
    room, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        if not fits:
            room.append(window)
            fits = [window]
        k = len(room) - 1 - room[::-1].index(min(fits))
        out[i] = min(fits)
        room[k] -= lengths[i]
    return out, sorted(room)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_best_fit_is_the_tightest(lengths):
    sequence, offset = packing.best_fit(np.array(lengths, np.int64), 60)
    room = collections.Counter()
    for i, s in enumerate(sequence.tolist()):
        room[s] += lengths[i]
    taken, left = plain_best_fit(lengths, 60)
    assert sorted(60 - used for used in room.values()) == left
    assert {i: 60 - o for i, o in enumerate(offset.tolist())} == taken


def checked(rows, texts, window):
    """Every id is in one piece, and sequences have no gap and at most ``window`` ids."""
    ids = {k: library_ids(t) for k, t in texts.items()}
    held = collections.defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        held[r.sequence_id].append((r.offset, r.length))
    starts = collections.defaultdict(list)
    for r in rows:
        starts[r.doc_id].append((r.start, r.length))
    for k, found in starts.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[k])
    for found in held.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= window
    return [sum(n for _, n in found) for found in held.values()]


@pytest.mark.parametrize("block", [7, 8192])
def test_packed(spark, block):
    texts = {i: prose(i, 5 + 37 * (i % 11)) for i in range(80)} | {900: None, 901: "", 902: "x" * 9000, 903: " ".join(prose(i, 400) for i in range(9))}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    rows = packing.packed(frame, PATH, block_pieces=block, window=512, ids=True).cache()
    used = checked(rows.collect(), texts, 512)
    assert len(used) < 1.2 * sum(used) / 512 + (1 if block > 1000 else 12)
    made = {r.sequence_id: r for r in packing.sequences(rows, window=512, pad=50256).collect()}
    ids = {k: library_ids(t) for k, t in texts.items()}
    for r in rows.collect():
        s = made[r.sequence_id]
        assert list(s.ids[r.offset : r.offset + r.length]) == ids[r.doc_id][r.start : r.start + r.length] == list(r.ids)
    for s in made.values():
        assert len(s.ids) == s.n_ids + packing.padding(s.n_ids, 512) and set(s.ids[s.n_ids :]) <= {50256}


def test_padding():
    assert [packing.padding(n, 2048) for n in (1, 3, 1024, 2000, 2048)] == [0, 2045, 0, 48, 0]


def test_packed_awkward_rows(awkward, empty):
    rows = packing.packed(awkward, PATH).collect()
    ids = [library_ids(r.text) for r in awkward.collect()]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    assert sum(r.start == 0 for r in rows) == awkward.count() and {r.doc_id for r in rows} == {r.doc_id for r in awkward.collect()}
    spans = [(r.sequence_id, r.offset + k) for r in rows for k in range(r.length)]
    assert len(set(spans)) == len(spans) and packing.packed(empty, PATH).collect() == []
