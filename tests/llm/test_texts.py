"""Token counts, license scan, quality rules, personal data and language ID against plain loops."""

import collections
import math
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

from changelens.llm import language_id, license_scan, pii, quality_rules, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
COUNTER = token_counts.TokenCounter(token_counts.Merges(PATH))


def library_count(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabte'sd123 .,!\n\t\r\x0b é日😀<|endoftext|>"), max_size=60))
def test_token_counts_equal_the_library(text):
    assert COUNTER.count([text]) == [library_count(text)]


def test_repeated_letters_merge_from_the_left():
    texts = ["a" * n for n in range(1, 60)] + ["ab" * n + "a" for n in range(20)]
    assert COUNTER.count(texts) == [library_count(t) for t in texts]


def test_token_counts_of_awkward_rows(awkward, empty):
    rows = token_counts.token_counts(awkward, PATH).collect()
    texts = [r.text for r in awkward.collect()]
    expected = [(len((t or "").encode()), library_count(t), library_count(t) > 1024) for t in texts]
    assert collections.Counter(tuple(r)[1:] for r in rows) == collections.Counter(expected)
    assert token_counts.token_counts(empty, PATH).collect() == []


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))


def test_quality_measures(awkward, empty):
    rows = quality_rules.quality(awkward).collect()
    expected = collections.Counter(plain_measures(r.text) for r in awkward.collect())
    assert collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == expected
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality(empty).collect() == []
    assert quality_rules.kept_documents(awkward).columns == awkward.columns


def test_repeated_windows_on_random_words(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    rows = quality_rules.quality(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, source string"))
    assert {r.doc_id: r.n_repeat_words for r in rows.collect()} == {i: plain_measures(t)[4] for i, t in enumerate(texts)}


def test_boilerplate_depletes_a_document_but_copies_do_not(spark):
    menu = "menu " * 3 + "home about contact terms privacy policy all rights reserved by the owner of this site"
    body = lambda i: prose(i, 25, 1)
    texts = [f"{menu}\n{body(i)}" for i in range(80)] + [f"{menu}\nfew words only {i}" for i in range(3)] + [body(999)] * 90
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    rows = {r.doc_id: r for r in quality_rules.quality(frame).collect()}
    assert all(rows[i].kept and rows[i].n_removed == len(menu.split()) for i in range(80))
    assert not any(rows[i].kept for i in range(80, 83))
    assert all(rows[i].kept and rows[i].n_removed == 0 for i in range(83, 173))
    assert sorted(r.doc_id for r in quality_rules.kept_documents(frame).collect()) == sorted(i for i in rows if rows[i].kept)


@pytest.mark.parametrize("hosts", [1, 4])
def test_lines_of_more_documents_than_the_limit_are_removed(spark, hosts):
    """The limit is of documents of one host, whatever the host's size, and copies count once."""
    rnd, rows = random.Random(hosts), []
    lines = [f"stock line number {'abcdefgh'[k]} of the site" for k in range(8)]
    for i in range(60):
        chosen = [x for k, x in enumerate(lines) if rnd.random() < k / 14]
        rows.append((i, "\n".join([*chosen, prose(i, 40, 2)]), None if hosts == 4 and i % 4 == 0 else f"s{i % hosts}"))
    rows += [(100 + i, *rows[i][1:]) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string")
    held = collections.defaultdict(set)
    for _, t, s in rows:
        for x in set(t.split("\n")):
            held[s, x].add(t)
    expected = {d: sum(len(x.split()) for x in t.split("\n") if len(held[s, x]) > 5) for d, t, s in rows}
    assert {r.doc_id: r.n_removed for r in quality_rules.quality(frame).collect()} == expected and any(expected.values())


def test_frequent_lines_are_cut_out_of_kept_documents(spark):
    menu = "Menu 12 home about contact terms privacy"
    texts = [f"{prose(i, 30, 2)}\n\n{menu.replace('12', str(i))}\n{prose(500 + i, 10, 1)}" for i in range(80)] + [prose(i, 40) for i in range(900, 910)]
    frame = spark.createDataFrame([(i, t, "s", i * 2) for i, t in enumerate(texts)], "doc_id int, text string, source string, other int")
    made = {r.doc_id: r for r in quality_rules.kept_documents(frame).collect()}
    assert set(made) == set(range(90)) and all(r.other == 2 * d for d, r in made.items())
    two = {i: re.sub("[0-9]+", lambda m: "0" * len(m[0]), menu.replace("12", str(i))) for i in range(80)}
    often = {x for x, n in collections.Counter(two.values()).items() if n > 5}
    assert len(often) == 2
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if re.sub("[0-9]", "0", x) not in often]
        assert made[i].text == "\n".join(lines) and (i not in two or (len(lines) < len(t.split("\n"))) == (two[i] in often))


def test_rows_that_lose_lines_are_told_by_bitmaps(spark):
    """Only rows that lose lines meet these, so the texts of the others are not shuffled; a bitmap holds 64 rows of a partition."""
    rows = spark.range(1000).repartition(3).select("id").withColumn("row_id", F.monotonically_increasing_id()).cache()
    numbers = {r.id: r.row_id for r in rows.collect()}
    lose = {i for i in numbers if i % 7 == 0 or i > 900 or numbers[i] % 64 == 63}
    gone = spark.createDataFrame([(numbers[i],) for i in lose], "row_id bigint")
    told = quality_rules.with_loses(rows, gone)
    assert told.columns == ["id", "row_id", "loses"]
    assert {r.id: r.loses for r in told.collect()} == {i: i in lose for i in numbers}
    assert not any(r.loses for r in quality_rules.with_loses(rows, gone.limit(0)).collect())


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_kept_documents_are_those_of_the_verdict_however_they_join(spark, threshold):
    texts = [f"{prose(i, 30, 2)}\nHome about contact" if i % 3 else prose(i, 10 + i) for i in range(60)]
    frame = spark.createDataFrame([(i // 2 * 2, t, "s") for i, t in enumerate(texts + texts[:4] + [None])], "doc_id int, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        kept = quality_rules.kept_documents(frame).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    verdicts = quality_rules.quality(frame).filter("kept").collect()
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in verdicts) and len(kept) > 40
    assert sum(r.n_words for r in verdicts) - sum(r.n_removed for r in verdicts) == sum(len(r.text.split()) for r in kept)
    assert sum(r.n_removed > 0 for r in verdicts) > 30 and not any("Home about" in r.text for r in kept)


def shingles(text):
    words = "".join(c for c in re.sub("[A-Z]", lambda m: m[0].lower(), text) if c not in license_scan.PUNCTUATION).split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def test_licenses_equal_exact_containment(spark, awkward, empty):
    rnd, texts = random.Random(2), []
    for i in range(60):
        name = rnd.choice(list(license_scan.TEMPLATES))
        words = license_scan.TEMPLATES[name].split()
        if i % 3 == 0 and len(words) > 20:
            words[rnd.randrange(len(words))] = "other"
        around = [f"w{rnd.randrange(999)}" for _ in range(40)]
        cut = rnd.randrange(40)
        texts.append(" ".join(around[:cut] + words + around[cut:]) + ("" if i % 4 else " " + " ".join(words).upper()))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {(r.doc_id, r.license): r.containment for r in license_scan.licenses(frame).collect()}
    expected = {}
    for i, t in enumerate(texts):
        for name, template in license_scan.TEMPLATES.items():
            share = len(shingles(template) & shingles(t)) / len(shingles(template))
            if share >= license_scan.CONTAINMENT:
                expected[i, name] = share
    assert set(found) == set(expected)
    assert license_scan.licenses(awkward).collect() == [] and license_scan.licenses(empty).collect() == []
    assert license_scan.licenses(frame, {"short": "too few words"}).collect() == []


@pytest.mark.parametrize("inserted", [20, 30, 40])
def test_a_broken_notice_is_scored_whole(spark, inserted):
    template = license_scan.TEMPLATES["MIT-text"]
    words = template.split()
    words[30:30] = [f"footer{k}" for k in range(inserted)]
    text = prose(1, 50) + " " + " ".join(words) + " " + prose(2, 300)
    far = " ".join(template.split()[:34]) + " " + prose(3, 900) + " " + " ".join(template.split()[30:])
    frame = spark.createDataFrame([(0, text), (1, far), (1, far)], "doc_id int, text string")
    found = {(r.doc_id, r.license): (r.containment, r.word) for r in license_scan.licenses(frame).collect()}
    share = lambda t: len(shingles(template) & shingles(t)) / len(shingles(template))
    assert share(text) > 0.93
    assert found == {(0, "MIT-text"): (share(text), 50), (1, "MIT-text"): (share(far), 0)}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def test_base_spans(spark, awkward, empty):
    rnd = random.Random(3)
    texts = [
        "a@b.c._d@e.f a@b@c.d", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111-1111 1111  4111111111111111 4111111111111111",
        "é😀 a.b+c@d-e.f😀+33 1 23 45 67 89. +1 (555) 123-4567 +++1 23", "a@" + "b." * 3000 + "c", "x" * 20_000 + "@y.com", "1-" * 5000 + "1",
    ]
    texts += ["".join(rnd.choice("ab1234567890@.+- ()%é\n") for _ in range(rnd.randint(5, 60))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: [tuple(s) for s in r.base] for r in pii.personal_data(frame).collect()}
    assert found == {i: plain_spans(t) for i, t in enumerate(texts)}
    assert collections.Counter(len(r.base) for r in pii.personal_data(awkward).collect()) == collections.Counter(
        len(plain_spans(r.text)) for r in awkward.collect()
    )
    assert pii.personal_data(empty).collect() == []


def test_terms_that_disclose_an_entity_are_marked(spark):
    names = ["anna", "carl", "dora", "emil", "fred", "gert", "hans", "inge"]
    rows = [(i, f"Please ask Zorblax about {n} or write to {n[::-1]} bob@x.org soon") for i, n in enumerate(names)]
    rows += [(100 + i, f"please ask about the thing or write to number {names[i % 8]} soon") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    shown = {r.doc_id: [t for t in r.all if t.kind == "term"] for r in pii.personal_data(frame, least_contexts=3).collect()}
    text = dict(rows)
    assert all(not shown[i] for i in range(100, 300))
    clean = {r.doc_id: r.text for r in pii.sanitised(frame).collect()}
    assert all("bob@x.org" not in clean[i] and "[EMAIL]" in clean[i] for i in range(8)) and clean[100] == text[100]
    near = spark.createDataFrame([(i, f"{n} zorblax bob@x.org {n[::-1]} soon") for i, n in enumerate(names)] + rows[8:], "doc_id int, text string")
    marked = {r.doc_id: [t for t in r.all if t.kind == "term"] for r in pii.personal_data(near).collect()}
    assert all([(s.start, s.end) for s in marked[i]] == [(5, 12)] for i in range(8))
    assert "zorblax" not in pii.sanitised(near).filter("doc_id = 0").first().text


def plain_disclosures(texts, disclosure, least):
    """(kind, value) to its disclosing terms, counted over different texts one by one."""
    texts = {t or "" for t in texts}
    spans, terms, contexts = {}, {}, collections.defaultdict(set)
    for t in texts:
        found = plain_spans(t)
        runs = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        terms[t] = {w for _, _, w in runs}
        free = [r for r in runs if not any(r[0] < s[2] and s[0] < r[1] for s in found)]
        named = [(s, (s[3], t[s[0] : s[2]].lower() if s[1] < 2 else re.sub("[^0-9]", "", t[s[0] : s[2]]))) for s in found]
        spans[t] = {e for _, e in named}, {w for _, _, w in free}
        for s, e in named:
            before, after = [w for _, end, w in free if end <= s[0]], [w for start, _, w in free if start >= s[2]]
            contexts[e].add((*before[-pii.CONTEXT :], *after[: pii.CONTEXT]))
    out = collections.defaultdict(set)
    for e in contexts:
        holding = [t for t in texts if e in spans[t][0]]
        if len(contexts[e]) < least or len(holding) < least or len(holding) == len(texts):
            continue
        for w in set().union(*(spans[t][1] for t in holding)):
            both, alone = sum(w in spans[t][1] for t in holding), sum(w in terms[t] for t in texts)
            mutual = math.log(both * len(texts) / (alone * len(holding)))
            if both >= least and mutual >= disclosure * math.log(len(texts) / len(holding)) - 1e-9:
                out[e].add(w)
    return out


def test_disclosing_terms_equal_a_count_over_all_texts(spark):
    rnd = random.Random(11)
    entities = ["bob@x.org", "Ann@y.com", "10.0.0.1", "+33 1 23 45 67 89", "4111 1111 1111 1111"]
    secrets = [["Zorblax", "quill"], ["marrow"], ["Ünder", "tarn"], ["vesper"], ["opal", "Zorblax"]]
    common = "the and house river walks under stone green seven paper light".split()
    texts = []
    for i in range(400):
        words = [rnd.choice(common) for _ in range(rnd.randint(3, 25))]
        if i % 4 == 0:
            k = rnd.randrange(5)
            # A secret may stand far from its entity, and now and then where there is none.
            words = [*rnd.sample(secrets[k], 1), *words, entities[k], *words[:2]]
        elif i % 29 == 0:
            words.append(rnd.choice(secrets[rnd.randrange(5)]))
        texts.append(" ".join(words))
    texts += texts[:40] + [None, "", "mail once@only.org zyx"] + [f"copy of copy@z.org wisp {'x' * i}" for i in range(2)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for disclosure, least in ((0.8, 3), (0.5, 2)):
        base = pii.base_spans(frame, "text", "doc_id")
        rows = pii.disclosing_terms(base, frame, "text", disclosure, least).collect()
        made = collections.defaultdict(set)
        for r in rows:
            made[(r.kind, r.value)].add(r.term)
        assert made == plain_disclosures(texts, disclosure, least)
        assert any("zorblax" in terms or "marrow" in terms for terms in made.values())


def test_sanitised_keeps_all_rows_and_columns(spark, awkward, empty):
    made = pii.sanitised(awkward)
    assert made.columns == awkward.columns and made.count() == awkward.count()
    assert made.filter("text is null").count() == awkward.filter("text is null").count()
    assert pii.sanitised(empty).collect() == []
    repeated = spark.createDataFrame([(1, "to a@b.org"), (1, "to a@b.org"), (None, "")], "doc_id int, text string")
    assert sorted(r.text for r in pii.sanitised(repeated).collect()) == ["", "to [EMAIL]", "to [EMAIL]"]


def test_gradient_is_that_of_the_loss():
    net = language_id.Network(["a", "b", "c"], hidden=4)
    for name in ("ahead", "back"):
        layer = getattr(net, name)
        layer.w, layer.u = layer.w.astype(np.float64), layer.u.astype(np.float64)
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    grid, lengths = language_id.padded([b"abcab", b"ba", b"c"])
    target = np.array([0, 1, 2])

    def loss():
        p, _ = net.label(grid, lengths)
        inside = np.arange(grid.shape[1]) < lengths[:, None]
        mine = np.take_along_axis(p, np.broadcast_to(target[:, None, None], (*grid.shape, 1)), 2)[:, :, 0]
        return -(np.log(mine) * inside).sum() / inside.sum()

    rng = np.random.default_rng(1)
    for value, slope in zip(net.parameters(), net.gradients(grid, lengths, target)):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape) if value.shape[0] != 256 else (int(rng.choice([97, 98, 99])), int(rng.integers(0, value.shape[1])))
            old = value[at]
            value[at] = old + 1e-3
            above = loss()
            value[at] = old - 1e-3
            below = loss()
            value[at] = old
            assert (above - below) / 2e-3 == pytest.approx(slope[at], abs=2e-3)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.languages(docs).collect()
    assert len(rows) == len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    tested = [r.lang_pred == known[r.doc_id] for r in rows if r.held_out]
    assert sum(tested) / len(tested) > 0.97


def test_windows_label_every_byte_once():
    for run in ("a", "b" * 32, "c" * 33, "é" * 400, "日本" * 111, "x" * 5000):
        raw, at = run.encode(), 0
        for window, low, high in language_id.windows_of(run):
            assert window[low:high] == raw[at : at + high - low] and window.decode()
            assert len(window) <= language_id.STRETCH + 2 * language_id.CONTEXT + 8
            at += high - low
        assert at == len(raw)


def test_marks_that_are_no_letters_have_no_language(spark):
    texts = ["² ½ ①", "12 34", "_ __", "", "Ⅷ", "ªº the and of", "the and of"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(100 + i, f"the house and water {i}", "en") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    made = {r.doc_id: r.lang_pred for r in language_id.languages(frame).collect()}
    assert [made[i] for i in range(7)] == ["und"] * 5 + ["en"] * 2


def test_languages_of_awkward_rows(awkward, empty):
    rows = language_id.languages(awkward).collect()
    assert len(rows) == awkward.count()
    blank = {r.doc_id: r for r in rows}
    for i in (0, 1, 2, 8):
        assert (blank[i].lang_pred, blank[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in rows} == {"und", "en"}
    assert language_id.languages(empty).collect() == []
