"""Importance resampling beside a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from glossmark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i: i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 50 for r in runs]


def plain(docs, target, longest):
    s, t = (Counter(b for text in texts for b in features(text, longest)[1]) for texts in ([d for _, d in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)]
    rows = []
    for key, text in docs:
        n, found = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        rows.append((key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return rows


def test_weights_and_ranks(spark, edge_docs, no_docs):
    docs = [(d.doc_id, d.text) for d in edge_docs.collect()]
    target = ["over tion stone 12 STONE and", None, "", "Ünder über stone7 " + "lane3 " * 40]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    for longest in (1, 3):
        rows = importance.weighed(edge_docs, aims, longest=longest, buckets=50)
        want = plain(docs, target, longest)
        assert sorted(map(tuple, rows.collect()), key=repr) == sorted(want, key=repr)
        got = importance.ranked(rows, percent=40, least_words=4).collect()
        assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
        long = [r for r in want if r[1] >= 4]
        order = sorted(long, key=lambda r: (-r[4], r[0] is not None, r[0] or 0))[: len(long) * 40 // 100]
        drawn = sorted((r.rank, r.score, r.doc_id) for r in got if r["rank"] is not None)
        assert drawn == [(i + 1, r[4], r[0]) for i, r in enumerate(order)]
    assert importance.ranked(importance.weighed(no_docs, aims)).count() == 0
    assert {r.weight for r in importance.weighed(edge_docs.where("text = ''"), aims.limit(0)).collect()} == {0}


def test_repeated_rows_get_a_rank_each(spark):
    rows = spark.createDataFrame([(None, 30, 30, 5, 9)] * 40 + [(1, 30, 30, 5, 9), (2, 30, 30, 5, 8), (3, 2, 2, 5, 99)], "doc_id long, n_words long, n_features long, weight long, score long")
    got = importance.ranked(rows, percent=95).collect()
    assert len(got) == 43 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 40))
    assert all(r["rank"] is None for r in got if r.doc_id)


def test_resampled_rows(edge_docs):
    drawn = importance.resampled(edge_docs, edge_docs.limit(3), percent=50)
    assert drawn.columns == edge_docs.columns and 0 < drawn.count() < edge_docs.count()
    assert drawn.exceptAll(edge_docs).count() == 0


def spans_of(parts):
    sizes = np.array([len(p) for p in parts], np.int64)
    return importance.Spans(np.frombuffer(b"".join(parts), np.uint8)), np.cumsum(sizes) - sizes, sizes


def test_keys_are_xxhash64():
    parts = [bytes((i * 7 + k) % 251 for k in range(n)) for i, n in enumerate([*range(1, 80), 500])]
    spans, starts, sizes = spans_of(parts)
    assert spans.keys(starts, sizes).tolist() == [xxhash.xxh64_intdigest(p) for p in parts]


class Clash(importance.Spans):
    def keys(self, starts, sizes):
        return np.full(len(starts), 7, np.uint64)


def test_equal_keys_are_told_apart_by_bytes():
    parts = [f"w{i % 90}".encode() * (1 + i % 3) for i in range(400)]
    spans, starts, sizes = spans_of(parts)
    for kind in (spans, Clash(spans.data[:-8])):
        table = importance.GramTable(kind, 1000, size=8)
        slots = [s for at in range(0, 400, 50) for s in table.intern(starts[at: at + 50], sizes[at: at + 50]).tolist()]
        last = table.intern(starts, sizes, count=False)
        named = dict(zip(parts, last.tolist(), strict=True))
        assert len(slots) == 400 and len(set(named.values())) == len(set(parts)) == table.used
        assert [named[p] for p in parts] == last.tolist()
        for part, n in Counter(parts).items():
            assert table.count[named[part]] == n and table.bucket[named[part]] == zlib.crc32(part) % 1000
