"""The operators on a small table of edge cases, each beside a plain version."""

import hashlib
import json
import math
import os
import random
import re
import tempfile
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmark.llm import line_quality, lm_score, mixing, ngram_join, pii, quality_rules, substring_dedup, url_filter, vector_search, word_bpe
from glossmark.llm.ef_trie import EliasFano, Trie, cells_of, codebook, counted_cells
from glossmark.llm.queries import tokenizer_definition
from tests.llm.edge_cases import edge_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


# --- mixing

def test_mix(edge_docs, no_docs):
    got = mixing.mix(edge_docs).collect()
    docs = edge_docs.collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((d.doc_id or 0, len(words(d.text))) for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len(words(d.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (5, 2, 1) * 2))
    targets, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:  # give by weight, fill those above twice their size, again
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
            open_.remove(s)
    targets |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.size * (r.target // max(r.source_size, 1)) <= r.taken <= 2 * r.size
    repeated = 4  # repeated rows at a cut share it evenly and may lose a word each
    assert all(abs(taken[s] - targets[s]) <= 0.5 + repeated for s in sizes)
    assert mixing.mix(no_docs).count() == 0
    assert rows_of(mixing.mix(edge_docs), "doc_id", "taken") == rows_of(mixing.mix(edge_docs), "doc_id", "taken")


def test_mixed_rows(edge_docs):
    mixed = mixing.mixed(edge_docs)
    assert mixed.columns == edge_docs.columns
    copies = Counter()
    for r in mixing.mix(edge_docs).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +copies


# --- quality classifier

def test_classifier(spark, edge_docs, no_docs):
    good = [(i, f"Line {i} of plain words that go on and on, as they do. " * 3, 1) for i in range(100, 200)]
    bad = [(i, "### $$ %% && ** " * (5 + i % 7), 0) for i in range(200, 300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(1, None), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (7, None), (100, 1), (9_999, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.classify(docs, labels).collect()}
    assert len(got) == 202
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert all(got[i].predicted == q for i, _, q in good + bad)
    for rows in (docs, edge_docs):  # the filter keeps what the scores say, by value
        kept = quality_rules.accepted(rows, labels)
        scores = quality_rules.classify(rows, labels) if rows is docs else None
        assert kept.columns == rows.columns and kept.count() > 0
        assert scores is None or sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scores.where("score >= 0.3").collect())
    scores = quality_rules.classify(edge_docs, labels.limit(0)).collect()
    assert len(scores) == edge_docs.count() and {r.score for r in scores} == {0.5}
    assert quality_rules.classify(no_docs, labels).count() == 0


# --- personal data

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def test_plain_personal_data(edge_docs, no_docs):
    found = pii.find_spans(edge_docs).join(edge_docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(found) == edge_docs.where("doc_id IS NOT NULL").count()
    for r in found:
        assert [(s.start, s.rank, s.kind, s.end) for s in r.base] == plain_spans(r.text)
    digest = {r.doc_id: r for r in pii.digest_columns(pii.find_spans(edge_docs)).collect()}
    assert digest[1].base_sha256 == hashlib.sha256(b"").hexdigest() and digest[1].spans == ""
    assert pii.digest_columns(pii.find_spans(no_docs)).count() == 0


def own_words(i, n=30):
    """Words that no other number has."""
    return " ".join(f"w{i}x{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(n))


def test_telling_terms(spark):
    name = lambda i: f"{own_words(i)} Reach Quendolin now at quen@mail.example.com today, number {i}. {own_words(i + 1000)} Quendolin left."
    texts = [name(i) for i in range(20)] + [f"{own_words(90)} Quendolin alone"]
    texts += [f"{own_words(i)} mail once@mail.example.com Singler today" for i in (60, 61)]  # two sights say nothing
    texts += [f"Plain note today and now, reach or left at number {i}" for i in range(300)]
    texts += [f"{own_words(50)} Copied here, copy@mail.example.com" for _ in range(40)]  # one text forty times
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _parts int")
    found = {r.doc_id: {(t.start, t.end, t.action) for t in r.terms} for r in pii.find_spans(docs).collect()}
    for i in range(21):  # every place, also in the text without the entity
        assert found[i] == {(m.start(), m.end(), "remove") for m in re.finditer("Quendolin", texts[i])}
    assert not any(found[i] for i in range(21, len(texts)))
    clean = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert "[EMAIL]" in clean[0].text and "Quendolin" not in clean[0].text and clean[0]._parts == 1
    assert clean[20].text == f"{own_words(90)}  alone" and all(clean[i].text == texts[i] for i in range(23, 323))


def test_disclosure_beside_a_plain_version(spark):
    pick = random.Random(5)
    people = {f"Name{'abcdefgh'[k]}": f"p{k}@mail.example.com" for k in range(8)}
    texts = []
    for i in range(240):
        who = pick.choice(list(people))
        texts.append(f"{own_words(i)} {who if pick.random() < 0.9 else 'nobody'} wrote {people[who] if pick.random() < 0.7 else 'home'} {pick.choice(['red', 'blue', 'green'])}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [({m.lower() for m in re.findall(r"[^\W\d_]{3,}", re.sub(r"\S+@\S+", " ", t))}, re.findall(r"\S+@\S+", t)) for t in texts]
    want = set()
    for i, (terms, mails) in enumerate(held):
        for term in terms:
            left = []
            for mail in mails:
                n_t, n_te = sum(term in x for x, _ in held), sum(term in x and mail in y for x, y in held)
                p = n_te / n_t
                low = (p + 2.706 / 2 / n_te - math.sqrt(2.706 * (p * (1 - p) / n_te + 2.706 / 4 / n_te**2))) / (1 + 2.706 / n_te)
                left.append(-math.log2(low))
            if left and min(left) <= 1:
                want |= {(i, m.start(), "remove" if min(left) <= 0.5 else "generalise") for m in re.finditer(rf"\b{term}\b", texts[i].lower())}
    got = {(r.doc_id, t.start, t.action) for r in pii.find_spans(docs).collect() for t in r.terms}
    assert want and {x for x in got if held[x[0]][1]} == want


def test_terms_of_a_long_text(spark):
    text = " ".join(f"wörd𝒳 {i} abc" for i in range(500))
    got = spark.range(1).select(pii._located(F.lit(text), pii.TERM).alias("x")).first().x
    assert [(x.start, x.value) for x in got] == [(m.start(), m[0]) for m in re.finditer(r"[^\W\d_]{3,}", text)]


# --- url filter

def test_url_filter(spark):
    def rule(host, path):
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y#z", "x://example.org/en/12", "http://org", "http://a.com/fr/", "http://B.com/de/1"]
    urls += [f"https://s{i % 9}.example.org/en/{i}" for i in range(200)] + [f"http://m{i % 7}.shop.com/de/{i}.html" for i in range(200)]
    urls += [f"https://s{i}.example.net/en/7" for i in range(9)] + [f"http://m{i}.shop.net/de/7.html" for i in range(7)]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, "http://q.net/", "", "")], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        verdict, name = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name)
        assert got[i].verdict == (verdict or got[i].verdict) in ("allow", "block")
    judged = got.values()
    assert all(r.verdict == "allow" for r in judged if r.host.endswith("example.net"))
    assert all(r.verdict == "block" for r in judged if r.host.endswith("shop.net"))
    alone = url_filter.judge_urls(pages.where("url LIKE '%.net%'")).collect()
    assert {r.verdict for r in alone} == {"allow"} and url_filter.judge_urls(pages.limit(0)).count() == 0


def test_gram_ratios_by_hand(spark):
    training = spark.createDataFrame([("aba", True), ("abb", False), ("ba", True)], "url string, accepted boolean")
    wanted = spark.createDataFrame([("ab",), ("aba",), ("c",)], "gram string")
    grams = {side: Counter() for side in (True, False)}
    for r in training.collect():
        for i in range(len(r.url)):
            for k in range(min(i, 2) + 1):
                grams[r.accepted][r.url[i - k: i + 1]] += 1

    def p(side, gram):
        if not gram:
            return 1 / url_filter.ALPHABET
        context = sum(n for g, n in grams[side].items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (grams[side][gram] + 4 * p(side, gram[1:])) / (context + 4)

    got = {r.gram: r.ratio for r in url_filter.gram_ratios(training, wanted, 2, 4.0).collect()}
    assert got == {g: pytest.approx(math.log(p(True, g) / p(False, g))) for g in ("ab", "aba", "c")}


# --- language model

@pytest.fixture(scope="module")
def lm_docs(spark, edge_docs):
    more = spark.createDataFrame([(100 + i, "the oak and the pine stand by the oak and rest " * (1 + i % 3)) for i in range(40)], "doc_id long, text string")
    return edge_docs.select("doc_id", "text").unionByName(more)


@pytest.mark.parametrize("held", [1 << 18, 6])
def test_lm_scores(lm_docs, no_docs, monkeypatch, held):
    monkeypatch.setattr(lm_score, "HELD_WORDS", held)
    got = sorted(lm_score.score_texts(lm_docs).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    docs = sorted(((d.doc_id, [*words(lower(d.text)), None]) for d in lm_docs.collect()), key=lambda d: (d[0] or 0, len(d[1])))
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(w for d, ws in docs if not out(d) for w in ws)
    total, forms = sum(c.values()), len(c)
    one = lambda w: (c[w] + 0.1) / (total + 0.1 * (forms + 1))
    # a plain version of the interpolated model over the words that the trie holds
    n = sorted(c[w] for w in c if w is not None)
    floor = min((k for k in set(n) if sum(x >= k for x in n) <= held), default=10**9)
    inside = {w for w in c if w is None or (c[w] >= floor and len(w.encode()) <= 48)} | {"<"}
    framed = [["<", *ws] for d, ws in docs if not out(d)]
    pairs = Counter(p for ws in framed for p in zip(ws, ws[1:]) if set(p) <= inside)
    pairs = {p: k for p, k in pairs.items() if k > 1}
    triples = Counter(t for ws in framed for t in zip(ws, ws[1:], ws[2:]) if t[:2] in pairs and t[1:] in pairs)
    triples = {t: k for t, k in triples.items() if k > 1}
    count = {**c, "<": len(framed)}
    rest1, rest2 = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    for (a, _), k in pairs.items():
        rest1[a] -= (k - 0.5) / count[a]
    for (a, b, _), k in triples.items():
        rest2[a, b] -= (k - 0.5) / pairs[a, b]

    def two(a, b):
        return ((pairs[a, b] - 0.5) / count[a] if (a, b) in pairs else 0) + (rest1[a] if a in inside else 1.0) * one(b)

    def three(t, a, b):
        return ((triples[t, a, b] - 0.5) / pairs[t, a] + rest2[t, a] * two(a, b)) if (t, a, b) in triples else (
            rest2[t, a] * two(a, b) if (t, a) in pairs else two(a, b))

    for r, (d, ws) in zip(got, docs, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d, out(d), len(ws), sum(c[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10(one(w)) for w in ws))
        seq = ["<", *ws]
        plain = sum(math.log10(three(seq[i - 2] if i > 1 else object(), seq[i - 1], seq[i])) for i in range(1, len(seq)))
        assert r.score == pytest.approx(plain, rel=1e-3)  # quantised to 4,096 values
    assert lm_score.score_texts(no_docs).count() == 0


def test_lm_scores_keep_every_ngram_in_any_slicing(lm_docs, monkeypatch):
    whole = {(r.doc_id, r.n_tokens): r.score for r in lm_score.score_texts(lm_docs).collect()}
    # caps of earlier rounds, and small slices and shards: each slice asks for its n-grams, none is left out
    for name, value in (("PAIRS", 2), ("TRIPLES", 1), ("TRIE_WORDS", 6), ("SLICE", 40), ("SHARD", 60)):
        monkeypatch.setattr(lm_score, name, value, raising=False)
    small = {(r.doc_id, r.n_tokens): r.score for r in lm_score.score_texts(lm_docs.repartition(5)).collect()}
    assert small == {k: pytest.approx(v, rel=1e-12) for k, v in whole.items()}


def test_lm_scores_are_quantised_by_one_table_for_all_slices(lm_docs, monkeypatch):
    scores = lambda docs: {(r.doc_id, r.n_tokens): (r.base_score, r.score) for r in lm_score.score_texts(docs).collect()}
    exact = scores(lm_docs)
    monkeypatch.setattr(lm_score, "LEVELS", 3, raising=False)
    coarse = scores(lm_docs)
    assert all(coarse[k][0] == pytest.approx(exact[k][0], rel=1e-12) for k in exact)
    assert sum(abs(coarse[k][1] - exact[k][1]) > abs(exact[k][1]) / 100 for k in exact) > len(exact) / 2
    for name, value in (("SLICE", 40), ("SHARD", 60)):
        monkeypatch.setattr(lm_score, name, value)
    assert {k: v[1] for k, v in scores(lm_docs.repartition(5)).items()} == {k: pytest.approx(v[1], rel=1e-12) for k, v in coarse.items()}


def test_codebook_of_a_grid():
    rng = np.random.default_rng(3)
    values = -np.abs(rng.normal(2, 1.5, 40_000))
    cells, n, parts = counted_cells(values)
    in_parts = Counter()
    for part in np.array_split(rng.permutation(values), 7):
        for cell, *sums in zip(*counted_cells(part)):
            in_parts[cell, 0] += sums[0]
            in_parts[cell, 1] += sums[1]
    assert [in_parts[c, 0] for c in cells] == n.tolist() and [in_parts[c, 1] for c in cells] == parts.tolist()
    codes, table = codebook(cells, n, parts, 64)
    found = codes[cells_of(values)]
    filled = np.bincount(found, minlength=64)
    assert len(table) == 64 and filled.min() > 40_000 / 64 * 0.9 and filled.max() < 40_000 / 64 * 1.1
    assert table == pytest.approx(np.bincount(found, values) / filled, abs=1e-9)
    few = np.repeat([-0.0, -0.3, -7.0, -15.9], 5)
    codes, table = codebook(*counted_cells(few), 64)
    assert table[codes[cells_of(few)]] == pytest.approx(few, abs=1e-9) and len(codebook(*counted_cells(few[:0]))[1]) == 0


def test_lm_scores_leave_no_shuffle_files_of_their_model(spark, lm_docs):
    folder = Path(os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir()))
    files = lambda: set(folder.glob("blockmgr-*/*/shuffle_*.data"))
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    scores = lm_score.score_texts(lm_docs)  # counts and model are made, the scores aren't yet
    assert spark.conf.get(name) == setting
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert scores.count() == lm_docs.count()


def test_elias_fano_places():
    rng = np.random.default_rng(8)
    for fill in (0.02, 0.5, 0.98):
        bits = rng.random(640) < fill
        values = np.flatnonzero(bits)
        made = EliasFano(EliasFano.parts(values))
        flags = np.unpackbits(made.high.view(np.uint8), bitorder="little")
        for bit in (0, 1):
            places = np.flatnonzero(flags == bit)
            assert made._place(np.arange(len(places)), bit).tolist() == places.tolist()


def test_elias_fano_and_trie():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 5), (300, 40), (5_000, 10**9), (1_000, 10**14)):
        values = np.sort(rng.integers(0, top, n))
        made = EliasFano(EliasFano.parts(values))
        assert (made.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top + 5, 500)])
        where, same = made.successor(asked)
        assert (same == np.isin(asked, values)).all()
        assert (where[same] == np.searchsorted(values, asked[same])).all()
    pairs = np.array(sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (200, 2))}))
    known = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    triples = np.array(sorted({(a, b, c) for a, b in known for d, c in known if d == b and (a + c) % 3 == 0}))
    logs = {"first": np.arange(30.0), "first_rest": np.arange(30.0), "second": np.arange(len(pairs)) * 1.0, "second_rest": np.arange(len(pairs)) * 1.0, "third": np.arange(len(triples)) * 1.0}
    trie = Trie.mapped(Trie.build(30, pairs, triples, logs))
    a, b = np.divmod(np.arange(900), 30)
    assert trie.pair(a, b).tolist() == [known.get((x, y), -1) for x, y in zip(a.tolist(), b.tolist())]
    place = {tuple(t): i for i, t in enumerate(triples.tolist())}
    asked = [(x, y, z) for x, y in known for d, z in known if d == y]
    ab, mid, bc = (np.array(v) for v in zip(*[(known[x, y], y, known[y, z]) for x, y, z in asked]))
    assert trie.triple(ab, mid, bc).tolist() == [place.get(t, -1) for t in asked]


# --- tokens

@pytest.mark.parametrize("held", [1 << 19, 5])
def test_bpe(edge_docs, no_docs, monkeypatch, held):
    from tokenizers import Tokenizer

    monkeypatch.setattr(word_bpe, "HELD_WORDS", held)
    definition = tokenizer_definition()
    plain = Tokenizer.from_str(definition)
    want = []
    for d in edge_docs.collect():
        ids = plain.encode(d.text or "", add_special_tokens=False).ids
        decoded = plain.decode(ids, skip_special_tokens=False)
        want.append((d.doc_id, d.source, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = word_bpe.encode(edge_docs, definition, keep=("source",))
    assert rows_of(got, "doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    ids = word_bpe.encode(edge_docs, definition, output="ids").where("doc_id = 5").first()
    assert ids.ids == plain.encode("One two  three", add_special_tokens=False).ids and ids.decoded == plain.decode(ids.ids)
    assert word_bpe.encode(no_docs, definition).count() == 0
    assert json.loads(definition)["model"]["type"] == "BPE"


# --- quality rules

def test_line_rules(spark, edge_docs, no_docs):
    got = rows_of(line_quality.judge_texts(edge_docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for d in edge_docs.collect():
        text, ws = d.text or "", words(d.text)
        lines = [x for x in text.split("\n") if words(x)]
        triples = Counter(tuple(ws[i: i + 3]) for i in range(len(ws) - 2))
        again = {i + k for i in range(len(ws) - 2) if triples[tuple(ws[i: i + 3])] > 1 for k in range(3)}
        want.append((d.doc_id, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
                     len(ws) < 50 or 100 * len(again) > 50 * len(ws)))
    assert got == sorted(want, key=repr)
    assert line_quality.judge_texts(no_docs).count() == 0
    letters = str.maketrans("0123456789", "abcdefghij")
    stock = "\n".join(" ".join(f"s{i}y{k}" for k in range(10)) for i in range(8)).translate(letters)  # no window stands twice
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(80)).translate(letters)
    rows = [(i, f"{stock}\n{i} end", "h") for i in range(30)] + [(100 + i, own(i), "h") for i in range(30)] + [(200, f"{stock}\n{own(99)}", "h")]
    judged = line_quality.judge_texts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert not any(r.base_failed for r in judged) and {r.n_line_words for r in judged} == {0, 80, 82}  # "3 end" and "4 end" are one line
    kept = {r.doc_id: r.kept for r in judged}
    assert not any(kept[i] for i in range(30)) and all(kept[i] for i in range(100, 130)) and kept[200]


def test_line_limit_is_the_same_in_large_hosts(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n)).translate(letters)
    stock = text(10**6, 60)
    shared = [(i, f"{stock}\n{text(i, 5)}", "h") for i in range(10)]
    few = [(i, f"{stock}\n{text(i, 5)}", "g") for i in range(9)] + [(9, f"{stock}\n{text(8, 5)}", "g")]  # nine distinct texts
    others = [(100 + i, text(i, 55), "h") for i in range(1500)]
    small, large, copies = (
        {r.doc_id: (r.kept, r.n_line_words) for r in line_quality.judge_texts(
            spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 10").collect()}
        for rows in (shared, shared + others, few))
    assert small == large == {i: (False, 60) for i in range(10)}
    assert copies == {i: (True, 0) for i in range(10)}


def test_common_lines_are_removed(spark):
    stock = "Home 12 | About"
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda i: "\n\n".join(" ".join(f"{c}{k}x{i}" for k in range(40)) for c in "vw").translate(letters)
    rows = [(i, f"{stock}\n{own(i)}\n{stock.lower()}", "h", "r") for i in range(12)]
    rows += [(50, f"{stock}\n{own(50)}", "g", "r"), (60, "too short", "h", "r"), (61, None, None, "r"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string")
    got = line_quality.cleaned(docs)
    assert got.columns == docs.columns
    want = [(i, own(i), "h", "r") for i in [0, *range(12)]] + [rows[12]]
    assert rows_of(got, *docs.columns) == sorted(want, key=repr)
    left = {r.doc_id: len(words(r.text)) for r in got.collect()}
    judged = line_quality.judge_texts(docs).where("kept").collect()
    assert {r.doc_id: r.n_words - r.n_line_words for r in judged} == left
    assert line_quality.cleaned(docs.limit(0)).count() == 0


# --- vectors

def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "RING", 16)
    monkeypatch.setattr(vector_search, "PIVOTS", 6)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(60)] + [(50, rows[7][1]), (50, rows[50][1]), (500, None), (501, [1.0, None]), (550, [float("nan")] * 8), (551, [float("inf")]), (600, []), (650, [0.5, -0.5]), (None, [1.0])]
    vectors = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, ids int")
    fit = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, (i, v) in enumerate(fit):
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for p, (j, w) in enumerate(fit) if p != q)[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    got = vector_search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert vector_search.top_k(vectors.limit(0), F.lit(True)).count() == 0
    few = vector_search.top_k(vectors.where("vec_id IN (1, 2, 3)"), F.lit(True), k=5)
    assert rows_of(few.groupBy("query_id").count(), "query_id", "count") == [(1, 2), (2, 2), (3, 2)]
    large = spark.createDataFrame([(i, [5.0e6 * (i + 1) + 1 / 256, 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    score = (256 * 5_000_000 + 1) * (256 * 10_000_000 + 1) + 256 * 256  # beyond 2**53, below 2**63
    assert rows_of(vector_search.top_k(large.where("vec_id < 2"), F.lit(True)), "query_id", "score") == [(i, score) for i in (0, 1)]
    with pytest.raises(ValueError, match="64 bits"):
        vector_search.top_k(large, F.lit(True))


# --- near copies

def plain_groups(docs, width, percent):
    sets = {}
    for d, text in docs:
        ws = words(lower(text))
        sets[d] = {tuple(ws[i: i + width]) for i in range(len(ws) - width + 1)} or ({tuple(ws)} if ws else set())
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


def test_similarity_groups(spark, edge_docs, no_docs):
    texts = edge_texts()
    base = prose(77, 90).split()
    for i in range(12):  # a chain: each link is near its neighbours only
        texts.append(" ".join(base))
        base = base[3:] + prose(700 + i, 3).split()
    docs = list(enumerate(texts, 1))
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, id int, digest int")
    for width, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_groups(frame, width, percent).collect()}
        assert got == plain_groups(docs, width, percent)
    groups = ngram_join.similarity_groups(edge_docs, 4, 85)
    assert groups.count() == edge_docs.count() and groups.where("doc_id IS NULL").first().component_id is None
    assert ngram_join.similarity_groups(no_docs, 4, 85).count() == 0
    kept = ngram_join.one_of_each(edge_docs, 5, 80)
    want = {d for d, (_, c) in plain_groups([(i, t) for i, t in enumerate(edge_texts(), 1)], 5, 80).items() if d == c}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([*want, 0]) and kept.columns == edge_docs.columns


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 70)], "a long, b long")
    assert dict(rows_of(ngram_join.components(links), "id", "component")) == {**{i: 1 for i in range(2, 41)}, 60: 50, 70: 50}


def jobs_of(spark, run):
    """What ``run`` returns, and the number of Spark jobs it started."""
    group = f"counted-{time.time()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_settled_links_take_one_step(spark):
    stars = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(50, 60), (70, 50)], "a long, b long")
    none, few = jobs_of(spark, lambda: ngram_join.components(stars.limit(0)))
    assert none.count() == 0 and few <= 3
    found, jobs = jobs_of(spark, lambda: ngram_join.components(stars))
    assert dict(rows_of(found, "id", "component")) == {**{i: 1 for i in range(2, 30)}, 60: 50, 70: 50}
    assert jobs <= 16


def test_rounds_without_new_pairs_send_nothing(spark, monkeypatch):
    made, ran = [], []
    picker, components = ngram_join.Picker, ngram_join.components
    monkeypatch.setattr(ngram_join, "Picker", lambda *a: made.append(picker(*a)) or made[-1])
    monkeypatch.setattr(ngram_join, "components", lambda edges: ran.append(1) or components(edges))
    base = prose(5, 60)
    docs = [(1, base), (2, base + " end"), (3, "Other " + base), *[(i, prose(1000 + i, 40)) for i in range(10, 20)]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_groups(frame, 5, 80).collect()}
    assert got == plain_groups(docs, 5, 80) and got[3][1] == 1
    assert len(made) == 1 and made[0].bits <= 16 and len(ran) == 2  # rows of one key, and the first round


# --- repeated passages

def plain_kept(docs, width):
    ws = [words(t) for t in docs]
    seen = Counter(tuple(w[i: i + width]) for w in ws for i in range(len(w) - width + 1))
    for w in ws:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i: i + width])] > 1:
                gone.update(range(i, i + width))
        yield len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("bits", [12, 22])
def test_remove_repeats(edge_docs, no_docs, bits):
    docs = edge_docs.collect()
    want = sorted(((d.doc_id, *k) for d, k in zip(docs, plain_kept([d.text for d in docs], 35))), key=repr)
    got = substring_dedup.remove_repeats(edge_docs, 35, 18, bits)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == want
    assert substring_dedup.remove_repeats(no_docs, bits=bits).count() == 0


def test_word_codes_come_back():
    import numpy as np
    import zstandard
    from glossmark.llm.word_bpe import expanded, squeezed

    press, open_up, draw = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor(), np.random.default_rng(3)
    for n in (0, 1, 2, 7, 500, 100_000):
        for top in (1, 2, 300, 2**19, 2**30):
            codes = draw.integers(0, top, n)
            assert (expanded(squeezed(codes, press), open_up) == codes).all()
