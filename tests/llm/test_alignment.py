"""Token alignment beside a plain version that tokenizes with the libraries and tries all pairs of a group."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from glossmark.llm import alignment
from glossmark.llm.queries import tokenizer_definition

DEFINITION = tokenizer_definition("byte_bpe_50k.json")
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
ARGS = (DEFINITION, public_tokenizers.PATTERN, MODEL)
EXTRA = ["<|endoftext|> <s> </s> <0x41> <unk>", "a▁b", "日本語 ½ \U0001f600‍", "x\x00y\r\n  z", "aaaa " * 900 + "ñandú", "ab" * 3000, " ", "\U0010fffd"]


@pytest.fixture(scope="module")
def texts(spark, edge_docs):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string")
    return edge_docs.unionByName(more, allowMissingColumns=True)


def plain(docs):
    """Rows of the contract, from the two libraries."""
    a_lib, b_lib = Tokenizer.from_str(DEFINITION), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    a_lib.encode_special_tokens = True
    letters = alignment.byte_letters()
    rows, count = [], Counter()
    for key, text in docs:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_lib.id_to_piece, b))]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            rows.append((key, [], [], [], []))
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, links, i, j = [], [], 0, 0
        for cut in cuts:
            k, m = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append((a[i:k], b[j:m]))
            for x, y in itertools.product(range(i, k), range(j, m)):
                if max(ends_a[x] - len(bytes_a[x]), ends_b[y] - len(bytes_b[y])) < min(ends_a[x], ends_b[y]):
                    links.append((a[x], b[y]))
            i, j = k, m
        count.update(links)
        rows.append((key, a, b, groups, links))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for key, a, b, groups, links in rows:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(told.encode()).hexdigest() if groups else ""
        out.append((key, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest))
    return out


@pytest.mark.parametrize(("chunk", "held"), [(1 << 16, 1 << 20), (700, 40), (40, 0)])
def test_alignment(texts, chunk, held):
    short = texts.where("text IS NULL OR length(text) < 10000") if chunk < 100 else texts
    want = plain([(d.doc_id, d.text) for d in short.collect()])
    got = alignment.align(short, *ARGS, chunk=chunk, held=held).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_kept_columns_and_empty_table(edge_docs, no_docs):
    got = alignment.align(edge_docs.limit(3), *ARGS, keep=("source", "row"))
    assert got.columns == ["doc_id", "source", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.count() == 3 and alignment.align(no_docs, *ARGS).count() == 0


def test_fragments_compose_in_any_grouping():
    known = alignment.Tokenizers(*ARGS)
    (a, b), = known.encoded(["Überlauf der Häuser: 'tis 12,345 strange unhyphenated words " * 8])
    whole = alignment.Fragment.of(a, b, *known.sizes.ends(a, b)).whole()
    for chunk in (1, 3, 7, 50):
        parts = alignment.fragments_of(known.sizes, a, b, chunk)
        left, right = parts[0], parts[-1]
        for p in parts[1:]:
            left = left.then(p)
        for p in parts[-2::-1]:
            right = p.then(right)
        middle = parts
        while len(middle) > 1:
            middle = [middle[i].then(middle[i + 1]) if i + 1 < len(middle) else middle[i] for i in range(0, len(middle), 2)]
        for made in (left, right, middle[0]):
            assert all(np.array_equal(x, y) for x, y in zip(made.whole(), whole, strict=True))


def test_unordered_merges_are_refused():
    changed = DEFINITION.replace('"Ġt":', '"Ġt_":').replace('"Ġthe":', '"Ġt":').replace('"Ġt_":', '"Ġthe":')
    if changed != DEFINITION:
        with pytest.raises(ValueError, match="order of merges"):
            alignment.Tokenizers(changed, public_tokenizers.PATTERN, MODEL)
