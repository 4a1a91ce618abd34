"""Splits, scores, report, selection, masking and consolidation on small fixtures."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from glossmark.operators import consolidation, evaluation, masking, ordering, quality, responses, selection, splits


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- order and ranks -----------------------------------------------------------


def test_order_statistics_match_sorting(spark):
    rng = random.Random(5)
    data = [(g, float(rng.choice([rng.gauss(0, 9), rng.randint(0, 4)]))) for g in ("a", "b", "c") for _ in range(rng.randint(1, 900))]
    df = spark.createDataFrame(data, "g string, v double")
    for row in ordering.five_numbers(df, "v", ["g"]).collect():
        s = sorted(v for g, v in data if g == row.g)
        n = len(s)
        assert (row.n, row.min, row.p25, row.p75, row.max) == (
            n, s[0], s[max(0, int(n * 0.25) - 1)], s[min(n - 1, int(n * 0.75))], s[-1],
        )
        assert row.median == pytest.approx(statistics.median(s))
        assert row["mean"] == pytest.approx(statistics.mean(s))


def test_order_statistics_whatever_the_cut_points(spark, monkeypatch):
    """Cut points that differ each time they are asked for, as a sketch's do when its parts arrive in another order."""
    points = F.udf(lambda low, high: sorted(random.uniform(low, high) for _ in range(63)), "array<double>").asNondeterministic()
    monkeypatch.setattr(ordering.F, "percentile_approx", lambda v, *_: points(F.min(v).cast("double"), F.max(v).cast("double")))
    rows = spark.range(9000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("v"))
    got = {r.g: (r.n, r.p25, r.median, r.p75) for r in ordering.five_numbers(rows, "v", ["g"]).collect()}
    for g, s in rows.groupBy("g").agg(F.sort_array(F.collect_list("v"))).collect():
        assert got[g] == (3000, s[749], (s[1499] + s[1500]) / 2, s[2250])


def test_worked_quartiles(spark):
    eight = spark.range(1, 9).toDF("v")
    got = ordering.five_numbers(eight, "v").first()
    assert (got.p25, got.median, got.p75) == (2.0, 4.5, 7.0)
    four = spark.range(1, 5).toDF("v")
    assert ordering.linear_percentiles(four, "v", {"q": 0.25}).first().q == 1.75


def test_rank_by_hash_is_the_global_rank(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("h"))
    ranked = ordering.rank_by_hash(df, "h", groups=["g"], digits=1, ties=["id"]).collect()
    for g in range(3):
        own = sorted((r.h, r.rank) for r in ranked if r.g == g)
        assert [k for _, k in own] == list(range(1, len(own) + 1))
        assert {r.group_size for r in ranked if r.g == g} == {len(own)}


# --- splits --------------------------------------------------------------------


@pytest.mark.parametrize("keys,ratio,expected", [(15, 0.7, 10), (2, 0.9, 1), (2, 0.1, 1), (10, 0.5, 5)])
def test_entity_split_sizes(spark, keys, ratio, expected):
    df = spark.range(keys * 3).select(F.concat(F.lit(" "), (F.col("id") % keys).cast("string")).alias("codigo"))
    got = splits.entity_split(df, "codigo", ratio, 1).collect()
    assert len(got) == keys and sum(r.split == "train" for r in got) == expected


def test_entity_split_needs_two_keys(spark):
    with pytest.raises(Exception, match="two distinct keys"):
        splits.entity_split(spark.createDataFrame([("a",)], "codigo string"), "codigo").collect()
    with pytest.raises(ValueError):
        splits.entity_split(spark.range(3), "id", 1.0)


def test_row_split(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 3)], "codigo string, id int")
    got = splits.split_rows(df, "codigo", mode="row", row_id=["codigo", "id"], train_ratio=0.9)
    counts = {tuple(r)[:2]: r["count"] for r in got.groupBy("codigo", "split").count().collect()}
    assert counts == {("a", "train"): 1, ("b", "train"): 2, ("b", "test"): 1}
    with pytest.raises(ValueError):
        splits.split_rows(df, "codigo", mode="other")


def test_leak_policies(spark):
    train = spark.createDataFrame([("a",), ("b",)], "k string")
    test = spark.createDataFrame([("b",), ("c",)], "k string")
    assert rows_of(splits.leaked_keys(train, test, "k")) == [("b",)]
    with pytest.raises(ValueError, match="b"):
        splits.apply_leak_policy(train, test, "k", "raise")
    assert rows_of(splits.apply_leak_policy(train, test, "k", "drop")[1]) == [("c",)]


def test_inheritance_and_aliases(spark):
    sides = spark.createDataFrame([("12.0", "train"), ("13", "test"), ("13", "train")], "codigo string, split string")
    derived = spark.createDataFrame([("12", 1), ("13", 2), ("99", 3)], "orig string, id int")
    got = splits.inherit_split(derived, "orig", sides, "codigo").select("id", "split")
    assert rows_of(got) == [(1, "train"), (2, "test"), (2, "train")]
    codes = spark.createDataFrame([("07",), ("08",), ("9",), ("010",)], "codigo string")
    files = spark.createDataFrame([("7",), ("08",), ("8",)], "stem string")
    assert rows_of(splits.repair_aliases(codes, "codigo", files, "stem").select("codigo", "resolved")) == [
        ("010", "010"), ("07", "7"), ("08", "08"), ("9", "9"),
    ]


def test_completeness(spark):
    want = spark.createDataFrame([("a",), ("b",)], "k string")
    splits.require_complete(want, want, "k")
    with pytest.raises(RuntimeError, match="b"):
        splits.require_complete(want, want.where("k = 'a'"), "k")


# --- evaluation ----------------------------------------------------------------


def keyed(spark, rows):
    return spark.createDataFrame(
        rows, "codigo string, pactivo_key string, reacadv_key string, frecuencia_key string, sistema_key string, pos int"
    )


def test_gold_matching(spark):
    gold = keyed(spark, [
        ("1", "p", "r", "frecuente", "s", 0), ("1", "p", "r", "rara", "s", 1), ("1", "p", "q", "rara", "s", 2),
        ("2", "p", "r", "rara", "s", 3),
    ])
    predicted = keyed(spark, [
        ("1", "p", "r", "muy frecuentes", "t", 0), ("1", "p", "r", "rara", "s", 1), ("1", "p", "z", "", "s", 2),
        ("3", "p", "r", "rara", "s", 0),
    ])
    scores = {r.codigo: r for r in evaluation.code_scores(gold, predicted, ["pos"]).collect()}
    one = scores["1"]
    assert (one.gold_rows, one.predicted_rows, one.matched, one.frequency_ok, one.system_ok, one.hallucinated) == (3, 3, 2, 1, 0, 1)
    assert scores["2"].file_missing and not one.file_missing and "3" not in scores
    tags = {r.tag: r for r in evaluation.tag_scores(evaluation.code_scores(gold, predicted, ["pos"])).collect()}
    assert (tags["REACADV"].correct, tags["REACADV"].missed, tags["REACADV"].spurious) == (2, 2, 1)
    assert tags["FRECUENCIA"].spurious == 0


def test_similar_systems(spark):
    gold = keyed(spark, [("1", "p", "r", "f", "sangre", 0), ("1", "p", "q", "f", "piel", 1)])
    predicted = keyed(spark, [("1", "p", "r", "f", "hematología", 0), ("1", "p", "q", "f", "oído", 1)])
    vectors = spark.createDataFrame(
        [("sangre", [1.0, 0.1]), ("hematología", [1.0, 0.0]), ("piel", [0.0, 1.0]), ("oído", [1.0, 0.0])],
        "text string, vector array<double>",
    )
    got = evaluation.match_gold(gold, predicted, ["pos"], vectors)
    assert {r.reacadv_key: r.system_ok for r in got.collect()} == {"r": True, "q": False}


def test_frequency_containment(one):
    both = evaluation.frequency_agrees(F.col("a"), F.col("b"))
    assert one(both, a="frecuente", b="muy frecuentes") and one(both, a="", b="rara")
    assert not one(both, a="rara", b="frecuente")
    assert not one(evaluation.frequency_equal(F.col("a"), F.col("b")), a="", b="rara")


def spans_frame(spark, rows):
    t = "array<struct<tag:string,start:int,end:int>>"
    return spark.createDataFrame(rows, f"g {t}, p {t}")


def test_span_schemas(spark):
    df = spans_frame(spark, [
        ([("A", 0, 2), ("A", 3, 5), ("B", 6, 7)], [("A", 0, 2), ("B", 3, 5), ("B", 6, 9), ("A", 10, 11)]),
        ([("A", 0, 4)], [("A", 0, 1), ("A", 2, 3)]),
    ])
    got = {
        r.schema: (r.correct, r.incorrect, r.partial, r.missed, r.spurious)
        for r in evaluation.span_schema_scores(df, "g", "p").where("tag = 'overall'").collect()
    }
    assert got == {
        "strict": (1, 3, 0, 0, 2), "exact": (2, 2, 0, 0, 2), "partial": (2, 0, 2, 0, 2), "ent_type": (3, 1, 0, 0, 2),
    }


def test_span_identities(spark):
    rng = random.Random(2)

    def side():
        out, at = [], 0
        while at < 12:
            at += rng.randint(0, 2)
            size = rng.randint(1, 3)
            out.append((rng.choice("AB"), at, at + size))
            at += size
        return out

    data = [(side(), side()) for _ in range(60)]
    for r in evaluation.span_schema_scores(spans_frame(spark, data), "g", "p").where("tag = 'overall'").collect():
        assert r.correct + r.incorrect + r.partial + r.missed == sum(len(g) for g, _ in data)
        assert r.correct + r.incorrect + r.partial + r.spurious == sum(len(p) for _, p in data)


@pytest.mark.parametrize("partial,expected", [(0, 0.6), (2, 0.7)])
def test_worked_scores(spark, partial, expected):
    df = spark.createDataFrame([(6, 2 - partial, partial, 2, 2)], "c int, i int, p int, m int, s int")
    seen = F.col("c") + F.col("i") + F.col("p")
    good = F.col("c") + F.lit(0.5) * F.col("p")
    row = evaluation.with_prf(df, good, seen + F.col("s"), seen + F.col("m")).first()
    assert (row.precision, row.recall, row.f1) == (expected, expected, expected)


def test_islands_change_no_score(spark):
    rng = random.Random(8)

    def side():
        out, at = [], 0
        for _ in range(rng.randint(0, 9)):
            at += rng.randint(0, 2)
            size = rng.randint(1, 3)
            out.append((rng.choice("AB"), at, at + size))
            at += size
        return out

    whole = spans_frame(spark, [(side(), side()) for _ in range(80)]).withColumn("id", F.monotonically_increasing_id())
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    cut = evaluation.overlap_islands(whole, ["id"], "g", "p")
    for score in (evaluation.span_schema_scores, evaluation.loose_overlap, evaluation.entity_counts):
        assert rows_of(score(whole, "g", "p")) == rows_of(score(cut, "g", "p"))


def test_loose_overlap(spark):
    row = evaluation.loose_overlap(spans_frame(spark, [([("A", 0, 2)], [("A", 1, 3), ("A", 5, 6)])]), "g", "p").first()
    assert (row.precision, row.recall, row.f1) == (0.5, 1.0, 0.6667)


# --- quality -------------------------------------------------------------------


def test_tuple_recovery_and_hallucination(spark):
    real = spark.createDataFrame(
        [("1", "P", "R1", "RARA", "S"), ("1", "P", "R2", "RARA", "S"), ("2", "P", "R", "RARA", "S"), ("1", "P", "x", None, "S")],
        "codigo string, pactivo string, reacadv string, frecuencia string, sistema string",
    )
    synth = spark.createDataFrame(
        [("1_v1", "1", "p", "r1 ", "rara", "s", "p", "r1", "raras", "s"), ("1_v1", "1", "p", "zz", "rara", "s", "p", "zz", "rara", "s")],
        "codigo string, orig_codigo string, pactivo_canonical string, reacadv_canonical string, frecuencia_canonical string, "
        "sistema_canonical string, pactivo string, reacadv string, frecuencia string, sistema string",
    )
    got = quality.tuple_recovery(real, synth).first()
    assert (got.codigo, got.real_tuples, got.recovered, got.ratio) == ("1", 2, 1, 0.5)
    rate = {r.type: (r.total_mentions, r.hallucinated) for r in quality.hallucination_rate(real, synth).collect()}
    assert rate == {"REACT": (2, 1), "ACTIVE": (2, 0), "FREQ": (2, 0), "SYS": (2, 0)}
    forms = {(r.canonical, r.surface): r.conformant for r in quality.frequency_forms(synth).collect()}
    assert forms == {("RARA", "raras"): True, ("RARA", "rara"): True}


# --- selection -----------------------------------------------------------------


def test_greedy_and_best(spark):
    rows = [("a", f) for f in "123"] + [("b", "4")] + [("c", "1")] + [("d", "5")] * 2 + [("e", "1"), ("e", "2"), ("e", "3")]
    index = selection.candidate_index(spark.createDataFrame(rows, "codigo string, frecuencia string"))
    picks = selection.greedy_examples(index, 4).orderBy("step").collect()
    assert picks[0].codigo in ("a", "e") and [p.codigo for p in picks[1:]] == ["b", "d", "c"]
    assert selection.best_candidate(index, ["zz", "d"]).first().codigo == "d"
    assert selection.best_candidate(index, exclude="a").first().codigo == "e"


def test_round_robin_takes_turns(spark):
    rows = [("c", "r%d" % i, "RARA", "S", i) for i in range(8)] + [("c", "q", "FRECUENTE", "S", 9), ("c", "", "RARA", "S", 10)]
    df = spark.createDataFrame(rows, "codigo string, reacadv string, frecuencia string, sistema string, id int")
    got = selection.round_robin(df, "codigo", 4, 1, ["id"]).collect()
    assert len(got) == 4 and sum(r.frecuencia == "FRECUENTE" for r in got) == 1


# --- masking -------------------------------------------------------------------


def test_windows_by_definition(spark):
    """Full coverage in order, no window over its capacity, words whole unless larger than a window, none left roomy."""
    rng, capacity = random.Random(9), 6
    cases = [[rng.choice([1, 1, 2, 3, 5, 6, 13, 17, 30]) for _ in range(rng.randint(1, 25))] for _ in range(150)]
    df = spark.createDataFrame([(i, [str(k) for k in range(len(c))], c) for i, c in enumerate(cases)], "doc int, words array<string>, sizes array<int>")
    placed = {}
    for r in masking.window_words(df, "doc", "words", "sizes", capacity).collect():
        placed.setdefault(r.doc, []).append((r.window_idx, r.word_idx, r["size"]))
    for i, case in enumerate(cases):
        rows = sorted(placed[i])
        assert [w for _, w, _ in rows] == sorted(w for _, w, _ in rows)
        used, last = {}, {}
        for no, word, size in rows:
            used[no] = used.get(no, 0) + size
            last[word] = last.get(word, 0) + size
        assert last == dict(enumerate(case)) and sorted(used) == list(range(len(used))) and max(used.values()) <= capacity
        for word, size in enumerate(case):
            places = [no for no, w, _ in rows if w == word]
            if size <= capacity:
                assert len(places) == 1
            first = next((no, n) for no, w, n in rows if w == word)
            opens = min(w for no, w, _ in rows if no == first[0]) == word
            if first[0] and opens:  # it could not have begun in the window before
                room = capacity - used[first[0] - 1]
                assert room == 0 or (size <= capacity and size > room)


def test_masks_reach_their_target(spark):
    df = spark.createDataFrame([(1, [str(k) for k in range(60)], [1 + k % 3 for k in range(60)])], "doc int, words array<string>, sizes array<int>")
    placed = masking.window_words(df, "doc", "words", "sizes", 20)
    total = {r.window_idx: r.n for r in placed.groupBy("window_idx").agg(F.sum("size").alias("n")).collect()}
    for r in masking.mask_words(placed, "doc").groupBy("window_idx").agg(F.sum("size").alias("n"), F.max("size").alias("m")).collect():
        target = max(1, round(total[r.window_idx] * 0.18))
        assert target <= r.n < target + 3


def test_vocabulary(spark):
    df = spark.createDataFrame([("Ácido úrico, para 12 DOLOR/fiebre",), (None,)], "t string")
    assert rows_of(masking.medical_vocabulary(df, "t")) == [("dolor",), ("fiebre",), ("ácido",), ("úrico",)]


# --- responses and consolidation -------------------------------------------------


def test_validation(spark):
    docs = spark.createDataFrame([(1, "Dolor agudo y tos.")], "doc_id int, text string")
    declared = spark.createDataFrame(
        [(1, 0, "REACT", "dolor", "DOLOR"), (1, 1, "REACT", "dolor", "DOLOR"), (1, 2, "SYS", "x", "agudo"), (1, 3, "SYS", "x", "to")],
        "doc_id int, pos int, type string, canonical string, surface string",
    )
    found, outcome = responses.validate_declared(docs, declared, "doc_id")
    assert rows_of(found.select("type", "surface", "start", "end")) == [("REACT", "DOLOR", 0, 5), ("SYS", "agudo", 6, 11)]
    row = outcome.first()
    assert (row.declared, row.matched, row.discard_ratio, row.accepted) == (4, 3, 0.25, True)


def test_validation_by_definition(spark):
    """First bounded place of each surface beside a plain search, in texts with repeats, marks and touching signs."""
    import re

    rng = random.Random(4)
    parts = ["dolor", "Dolor", "do", "tos", "(tos)", "tos-do", "éxito", "muy", " ", ", ", ".", "_", "9"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for i in range(30)}
    plain = lambda t: t.lower().replace("é", "e")
    asked = [(i, k, "REACT", "c", s) for i in [*texts, 99] for k, s in enumerate(["DOLOR", "dolor", "do", "(tos)", "tos, ", "exito", "muy dolor", "", None])]
    docs = spark.createDataFrame([*texts.items(), (98, None)], "doc_id int, text string")
    declared = spark.createDataFrame([*asked, (98, 0, "SYS", "c", "do")], "doc_id int, pos int, type string, canonical string, surface string")
    found, outcome = responses.validate_declared(docs, declared, "doc_id")
    want = set()
    for i, _, _, _, surface in asked:
        hit = surface and i in texts and re.search(r"(?<!\w)" + re.escape(plain(surface)) + r"(?!\w)", plain(texts[i]))
        if hit:
            want.add((i, surface, *hit.span()))
    assert set(rows_of(found.select("doc_id", "surface", "start", "end"))) == want
    counts = {r.doc_id: (r.declared, r.matched) for r in outcome.collect()}
    assert counts[98] == (1, 0) and counts[99] == (9, 0) and len(counts) == 32


def test_extraction_rejects_whole_code(spark):
    rows = [("1", "a", '[{"x":"1"}]'), ("1", "b", "nada"), ("2", "a", '[{"principio activo":""},{"y":"2"}]')]
    df = spark.createDataFrame(rows, "codigo string, activo string, r string")
    records, status = responses.extraction_outcome(df, "codigo", "activo", "r")
    assert {r.codigo: (r.status, r.errors) for r in status.collect()} == {"1": ("error", 1), "2": ("processed", 0)}
    assert [r.item["principio activo"] for r in records.orderBy("pos").collect()] == ["", "a"]


@pytest.mark.parametrize("types,n_rows,first", [(["REACT", "REACT", "FREQ", "FREQ"], 4, "REACT"), (["FREQ", "SYS"], 3, "FREQ")])
def test_consolidation(spark, types, n_rows, first):
    entities = [(t, "" if i == 0 else "C", f"s{i}", 0, 1) for i, t in enumerate(types)]
    docs = spark.createDataFrame(
        [("1", "1_v2", 2, "", entities), ("9", "9_v1", 1, "m", [])],
        "codigo string, codigo_variant string, variante int, medicamento string, "
        "entities array<struct<type:string,canonical:string,surface:string,start:int,end:int>>",
    )
    names = spark.createDataFrame([("1", "Nombre")], "codigo string, medicamento string")
    got = consolidation.consolidate(docs, names).collect()
    assert len(got) == n_rows and {r.medicamento for r in got} == {"Nombre"} and {r.codigo for r in got} == {"1_v2"}
    if first == "REACT":
        stamped = [r for r in got if r.reacadv]
        assert [(r.reacadv, r.reacadv_canonical, r.frecuencia) for r in stamped] == [("s0", "s0", "s2"), ("s1", "C", "s2")]
        assert sorted(r.frecuencia for r in got if not r.reacadv) == ["s2", "s3"]


def test_islands_of_many_rows_need_no_shuffle(spark):
    rng = random.Random(3)

    def spans():
        at, out = 0, []
        for _ in range(rng.randint(0, 9)):
            start = at + rng.randint(0, 3)
            at = start + rng.randint(1, 4)
            out.append((rng.choice("AB"), start, at))
        return out

    rows = [(i, spans(), spans()) for i in range(300)] + [(300, [("A", 0, 1)], None), (301, [], [])]
    kind = "array<struct<tag:string,start:int,end:int>>"
    cut = evaluation.overlap_islands(spark.createDataFrame(rows, f"id int, g {kind}, p {kind}"), ["id"], "g", "p")
    assert not {"Window", "Aggregate"} & set(re.findall(r"\w+", cut._jdf.queryExecution().optimizedPlan().toString()))
    want = []
    for i, g, p in rows[:-2]:
        reach, islands = -1, []
        for side, s in sorted([(0, s) for s in g] + [(1, s) for s in p], key=lambda x: (x[1][1], x[1][2])):
            if s[1] >= reach:
                islands.append(([], []))
            islands[-1][side].append(s)
            reach = max(reach, s[2])
        want += [(i, a, b) for a, b in islands]
    assert sorted((r.id, [tuple(x) for x in r.g], [tuple(x) for x in r.p]) for r in cut.collect()) == sorted(want)


def test_label_hits_as_spans_give_them(spark):
    from glossmark.functions.labels import label_spans

    rng = random.Random(4)
    marks = ["O", "B-X", "I-X", "B-Y", "I-Y", "I-Z", None]
    rows = [([rng.choice(marks) for _ in range(n)], [rng.choice(marks) for _ in range(rng.choice([n, n, 3]))]) for n in [0, 1, 2, 5, 9, 14] * 30]
    cells = spark.createDataFrame([*rows, (None, ["B-X"])], "gold array<string>, pred array<string>").repartition(3)
    spans = cells.select(label_spans(F.col("gold")).alias("g"), label_spans(F.col("pred")).alias("p"))
    plain = evaluation.entity_counts(spans.select(F.coalesce("g", F.slice("p", 1, 0)).alias("g"), "p"), "g", "p")
    assert sorted(evaluation.label_hits(cells, "gold", "pred").collect()) == sorted(plain.collect())
    assert evaluation.label_hits(cells.limit(0), "gold", "pred").count() == 0
