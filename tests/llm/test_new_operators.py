"""Personal data, collocations and fill-in-middle against plain versions, and their odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold.llm import collocations, fill_in_middle, personal_data
from wayfold.llm.common import utf8

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n int, key string, phrase string, place int, found int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "k", "p", 2, 3) for i, t, lang in rows], SCHEMA)


# --- personal data ---------------------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a", "b.", "@", ".", "-", "1", "22", "333", "4444", "0255", "+", "+1", " ", "(", ")", "%", "é", "@x.de", "5555 4444", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert personal_data.base_spans(text) == plain_base(text), text


def test_base_of_documents(docs):
    got = {r.doc_id: r for r in personal_data.personal_data(docs).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        base = plain_base(r.text or "")
        listed = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in base)
        own = got[r.doc_id]
        assert own.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [own.n_email, own.n_ip, own.n_card, own.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert not base or set(listed.split(",")) <= set(own.spans.split(","))
        assert len([x for x in own.spans.split(",") if x]) == len(base) + own.n_added


#: Personal data that the base patterns miss or take too much of, and what must not be taken.
PLANTED = [
    ("pay with 4465758382889437 4465758382889437 now", "card", "4465758382889437"),
    ("Call +1 (743) 555-3824 4465758382889437 now", "phone", "+1 (743) 555-3824"),
    ("mail me: john [at] mail [dot] example [dot] com please", "email", "john [at] mail [dot] example [dot] com"),
    ("write to jane at example dot org today", "email", "jane at example dot org"),
    ("contact jürgen@exämple.de or", "email", "jürgen@exämple.de"),
    ("phone (743) 555-3824 after six", "phone", "(743) 555-3824"),
    ("IBAN DE89 3704 0044 0532 0130 00 at the bank", "iban", "DE89 3704 0044 0532 0130 00"),
    ("greetings, Dr. Maria Schmidt and", "name", "Maria Schmidt"),
]
CLEAN = [
    "meet me at example.com or at noon. dot the i", "the price is 1234 5678 and 99 of 100", "chapter 1.2.3 of 2024-11-28 12:30:45",
    "order 550e8400-e29b-41d4-a716-446655440000 shipped", "Look @ home. It was", "a list: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15",
]


def test_spans_that_patterns_miss(spark, docs):
    """Among ordinary documents, held-out cases of each kind are found, and clean texts are left alone."""
    rows = [(10_000 + i, t, "en") for i, (t, _, _) in enumerate(PLANTED)] + [(20_000 + i, t, "en") for i, t in enumerate(CLEAN)]
    both = docs.select("doc_id", "text").union(frame(spark, rows).select("doc_id", "text"))
    got = {r.doc_id: r.spans for r in personal_data.personal_data(both).where("doc_id >= 10000").collect()}
    for i, (text, kind, value) in enumerate(PLANTED):
        start = text.index(value)
        assert f"{kind}:{start}:{start + len(value)}" in got[10_000 + i].split(","), (text, got[10_000 + i])
    assert [got[20_000 + i] for i in range(len(CLEAN))] == [""] * len(CLEAN)


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(2)
    accuracy, n = np.array([0.95, 0.9, 0.85, 0.8, 0.7, 0.9]), 20_000
    truth = rng.random(n) < 0.6
    right = rng.random((n, 6)) < accuracy
    votes = np.where(rng.random((n, 6)) < 0.3, personal_data.SILENT, np.where(right, truth[:, None], ~truth[:, None]).astype(int))
    counted = Counter(map(tuple, votes.tolist()))
    found, posterior = personal_data.reliabilities([(0, v, c) for v, c in counted.items()])
    assert np.abs(found[:, 1] - accuracy).max() < 0.03 and np.abs(1 - found[:, 0] - accuracy).max() < 0.03
    assert np.mean([(posterior[(0, tuple(v))] > 0.5) == t for v, t in zip(votes.tolist(), truth)]) > 0.95


def test_personal_data_odd_rows(spark):
    long = "x" * 300_000 + " a@b.cd " + "1" * 300_000 + "@" * 5_000 + " 5555 5555 5555 4444"
    rows = [(1, None, "en"), (2, "", "en"), (None, "a@b.cd", None), (3, "a@b.cd", "en"), (3, "a@b.cd", "en"), (4, long, "en")]
    got = personal_data.personal_data(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.spans, r.n_email) for r in got if r.doc_id != 4) == [(0, "email:0:6", 1), (1, "", 0), (2, "", 0), (3, "email:0:6", 1), (3, "email:0:6", 1)]
    assert next(r.spans for r in got if r.doc_id == 4).startswith("email:300001:300007")
    assert personal_data.personal_data(frame(spark, [])).collect() == []


def test_many_candidates_in_one_text():
    text = "(743) 555-3824 and " * 5_000
    found = [x.__dict__ for x in personal_data.candidates(text)]
    assert len(personal_data.chosen(found, np.ones(len(personal_data.features(0, True, [1] * 6, "", "x"))))) == 5_000


# --- collocations ----------------------------------------------------------------------------------------------------


def plain_pieces(text):
    low = text.translate({c: c + 32 for c in range(65, 91)})
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", low)]


def plain_collocations(rows, longest=3, least=10, top=2_000, percent=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for words in plain_pieces(text or ""):
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        holds = defaultdict(int)
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    holds[p[i : i + size]] = max(holds[p[i : i + size]], a)
        for p, a in candidates.items():
            if 100 * holds[p] >= percent * a:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), a, le, r, n[lang], -s) for rank, (s, _, p, a, le, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def spoken(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "Straße", "a-b", "x\x0by", "\x00", "été", "to", "be"]
    return [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for i in range(n)]


@pytest.mark.parametrize(("longest", "shard", "n_bits"), [(3, 2_000_000, 1 << 26), (3, 500, 64), (4, 900, 1 << 12), (2, 100, 128)])
def test_collocations_equal_plain_counts(spark, longest, shard, n_bits):
    """Whatever the size of shards and of the filter: one that lets everything through gives the same rows."""
    rows = spoken(longest)
    got = collocations.collocations(frame(spark, rows), longest=longest, top=50, shard=shard, n_bits=n_bits).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, longest, top=50)


def test_both_extensions_give_the_same_intervals():
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdef") for _ in range(3_000)) + "."
    data = np.frombuffer(text.encode(), np.uint8)
    words, opens = collocations.split_words(data, np.array([0, 1_001, len(data)]))
    coded = words.dictionary_encode()
    index = collocations.PhraseIndex(coded.indices.to_numpy(), opens, len(coded.dictionary), 4)
    by_right = index.extend_right(index.extend_right(index.extend_right(index.words())))
    by_both = index.extend_left(index.extend_right(index.extend_left(index.words())))
    as_set = lambda p: {(*s, *x) for s, *x in zip(map(tuple, p.symbols.tolist()), p.forward.tolist(), p.backward.tolist(), p.count.tolist())}
    assert as_set(by_right) == as_set(by_both) and len(by_right.count) > 500


def test_words_and_pieces():
    texts = ["One, two  three.four", "", "\t", "é!É x\x0by Z", "a"]
    words, opens = collocations.split_words(*utf8(pa.array(texts)))
    assert [w.decode() for w in words.to_pylist()] == ["one", "two", "three", "four", "é", "É", "x", "y", "z", "a"]
    assert opens.tolist() == [True, True, False, True, True, True, False, True, False, True]


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    row = spark.range(1).select(collocations._score(F.lit(big - 1), F.lit(big), F.lit(big)).alias("s")).first()
    assert row.s == 1_000_000 * (big - 1) ** 2 // big**2


def test_collocations_odd_rows(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, "en"), (2, "", None)])).collect() == []
    long = "red house " * 60_000
    got = collocations.collocations(frame(spark, [(1, long, None), (None, "red house", None), (1, "red house", None)])).collect()
    assert [(r.lang, r.phrase, r.a, r.n) for r in got] == [("und", "house red house", 59_999, 120_004), ("und", "red house red", 59_999, 120_004)]


# --- fill in middle --------------------------------------------------------------------------------------------------


def plain_fim(doc_id, text, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(lines), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def fim_rows():
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["é", "ab", "\n", "\n\n", "<P", ">", "😀", "\r"]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    long = "\n".join("line %d of a long text" % i for i in range(40_000))
    rows += [(400, None), (401, ""), (402, "a <M> b\nc"), (403, long), (404, "x" * 500_000), (405, long + "\n"), (None, "a\nb\nc"), (None, None)]
    return rows + [(406, "a\nb\nc\nd"), (406, "a\nb\nc\nd"), (406, "a\nb\nc\nd"), (406, "other\ntext"), (403, long)]


def test_fill_in_middle(spark):
    rows = fim_rows()
    got = fill_in_middle.fill_in_middle(frame(spark, [(i, t, "en") for i, t in rows])).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_fim(i, t)) for i, t in rows)
    assert fill_in_middle.fill_in_middle(frame(spark, [])).collect() == []


def test_chunks_make_up_the_output(spark):
    rows = {i: t for i, t in fim_rows() if i is not None and i < 406}
    got = defaultdict(list)
    for r in fill_in_middle.outputs(frame(spark, [(i, t, "en") for i, t in rows.items()])).collect():
        got[r.doc_id].append((r.place, bytes(r.bytes)))
    for i, t in rows.items():
        pieces = [b for _, b in sorted(got[i])]
        assert hashlib.sha256(b"".join(pieces)).hexdigest() == plain_fim(i, t)[5]
        assert all(len(b) <= fill_in_middle.CHUNK + 3 for b in pieces)
