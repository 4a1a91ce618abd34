"""Scalar and array expressions against worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from glossmark.functions import keys, labels, numeric, prompts, text
from glossmark.operators import responses
from glossmark.operators.quality import frequency_text


def test_fold(one):
    assert one(text.fold(F.col("t")), t="Émbolo AGUDO") == "embolo agudo"
    assert one(F.length(text.fold(F.col("t"))), t="ﬁn…½") == 4
    assert one(text.fold_compat("t"), t="ﬁn") == "fin"


def test_casefold_keeps_accents(one):
    assert one(text.nfkc_casefold("t"), t="  Straße ÉL ") == "strasse él"
    assert one(text.nfkc_casefold(F.lit(None).cast("string"))) == ""


def test_trim_and_norm(one):
    assert one(text.ws_trim(F.col("t")), t=" \n a b  ") == "a b"
    assert one(text.norm_lower(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("value,expected", [("  a  b\nc ", 3), ("", 0), (" ", 0)])
def test_word_count(one, value, expected):
    assert one(text.word_count(F.col("t")), t=value) == expected


def test_slug(one):
    assert one(text.slug(F.col("t")), t=" Dolor (agudo)!") == "dolor__agudo"
    assert one(text.slug(F.col("t"), default="react"), t="!!") == "react"


def test_cuts(one):
    body = "uno|\n---dos\nSEGUNDA nota aquí\ntres"
    assert one(text.sanitise_section(F.col("t"), "segunda NOTA"), t=body) == "uno\ndos"
    assert one(text.sanitise_section(F.col("t"), "ausente"), t="a|b") == "ab"
    assert one(text.excerpt(F.col("t"), "X", 3), t="abcdX") == "abc\n[...]"
    assert one(text.excerpt(F.col("t"), "X", 9), t="Xabc") == "Xabc"


def test_html(one):
    html = "<p>Uno &amp; dos<!-- no --></p><script>x<1</script><td>a</td><td>b</td>"
    assert one(text.html_text(F.col("t")), t=html) == "Uno & dos\na b "


@pytest.mark.parametrize("html,want", [
    ("<UL><li>a<ol><li>b</li><li>c</li></ol><li>d</UL>fin", "- a\n  1. b\n  2. c\n- d\nfin"),
    ("<table><tr><td><p>1</p><p>2</p><td>3<tr><th>4<br>5</table>x", "1 2 3\n4 5\nx"),
    ("<table><tr><td><table><tr><td>i</td></tr></table>o</td></tr></table>", "i o \n"),
    ("&#233;&#xE9;&euro;&Ntilde;&amp;lt;&nada;", "éé€Ñ&lt;&nada;"),
    ("3 < 4 <b title='x>y'>y</b> <!-- sin fin", "3 < 4 y "),
    ("<style>p{}</style><script>var t='</p>';</script></div>a</li></ol>", "a\n"),
    ("", ""),
])
def test_html_layout(one, html, want):
    assert one(text.html_text(F.col("t")), t=html) == want


def test_html_references_end_in_a_semicolon(one):
    html = "a&amp</li>b &amp c &#233 &ampx; &amp;&#233;&copy;"
    assert one(text.html_text(F.col("t")), t=html) == "a&amp\nb &amp c &#233 &ampx; &é©"


def test_html_null_and_unclosed_tags_in_bulk(one):
    assert one(text.html_text(F.col("t").cast("string")), t=None) is None
    assert one(F.length(text.html_text(F.col("t"))), t="<td>ñ" * 20000) == 40000 - 1


@pytest.mark.parametrize("code,expected", [(" 0119.0", "0119"), (" 077\n", "077"), ("x.0", "x.0")])
def test_normalise_code(one, code, expected):
    assert one(keys.normalise_code(F.col("c")), c=code) == expected


@pytest.mark.parametrize("code,expected", [("0012_v2", "12_v2"), ("000", "0"), ("00_v1", "0_v1"), ("0a_v1_v2", "a_v1_v2")])
def test_variant_key(one, code, expected):
    assert one(keys.variant_key(F.col("c")), c=code) == expected


def test_label_vocabulary():
    assert labels.label_vocabulary(["SYS", "REACT", "SYS"]) == {
        "O": 0, "B-SYS": 1, "I-SYS": 2, "B-REACT": 3, "I-REACT": 4,
    }
    with pytest.raises(ValueError, match="allowed"):
        labels.check_types(["NOPE"])
    with pytest.raises(ValueError):
        labels.check_types([])


def test_repair_and_spans(one):
    raw = ["I-A", "O", "I-A", "I-A", "B-A", "I-F"]
    assert one(labels.repair_bio(F.col("x")), x=raw) == ["B-A", "O", "B-A", "I-A", "B-A", "B-F"]
    got = one(labels.label_spans(F.col("x")), x=["B-A", "I-A", "O", "B-A", "B-A"])
    assert [tuple(s) for s in got] == [("A", 0, 2), ("A", 3, 4), ("A", 4, 5)]


def test_repair_and_spans_random(spark):
    rng = random.Random(3)
    marks = ["O", "B-A", "I-A", "B-F", "I-F"]
    rows = [(i, [rng.choice(marks) for _ in range(rng.randint(1, 9))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x array<string>")
    for r in df.select("x", labels.repair_bio(F.col("x")).alias("y"), labels.label_spans(F.col("x")).alias("s")).collect():
        fixed, open_type, spans = [], None, []
        for i, label in enumerate(r.x):
            kind = None if label == "O" else label[2:]
            if kind is None:
                fixed.append("O")
            elif label[0] == "B" or kind != open_type:
                fixed.append("B-" + kind)
                spans.append([kind, i, i + 1])
            else:
                fixed.append(label)
                spans[-1][2] = i + 1
            open_type = kind
        assert r.y == fixed
        assert [list(s) for s in r.s] == spans


def test_alignment_and_ids(one):
    got = one(labels.align_subwords(F.col("n"), F.col("ids")), n=[2, 1, 3], ids=[1, 0, 2])
    assert got == [1, -100, 0, 2, -100, -100]
    vocabulary = labels.label_vocabulary(["REACT"])
    assert one(labels.ids_to_labels(F.col("x"), vocabulary), x=[1, -100, 0]) == ["B-REACT", "O"]
    assert one(labels.label_types(F.col("x")), x=["B-A", "O", "I-A"]) == ["A", "O"]


def test_sublist(one):
    assert one(labels.find_sublist(F.col("a"), F.array(F.lit(1), F.lit(1))), a=[1, 1, 1, 2]) == [0, 1]
    assert one(labels.find_sublist(F.col("a"), F.expr("cast(array() as array<int>)")), a=[1]) == []


def test_numbers(one):
    assert one(numeric.cosine(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[2.0, 1.0]) == pytest.approx(0.8)
    assert one(numeric.discard_ratio(F.lit(3), F.lit(4))) == 0.25
    assert one(numeric.discard_ratio(F.lit(0), F.lit(0))) == 0.0
    assert one(numeric.argmax(F.col("a")), a=[0.1, 0.7, 0.7]) == 1
    assert one(numeric.top_k_hit(F.col("a"), F.lit(0), 2), a=[0.5, 0.7, 0.1]) is True
    assert one(numeric.warmup_steps(F.lit(33), 16, 10, 0.1)) == 3


@pytest.mark.parametrize("value,expected", [
    ("POCO FRECUENTE ", "poco frecuentes"), ("Sin Frecuencia", "frecuencia no conocida"), ("Otra", "otra"),
])
def test_frequency_text(one, value, expected):
    assert one(frequency_text(F.col("f")), f=value) == expected


def test_frequency_text_null(one):
    assert one(frequency_text(F.lit(None).cast("string"))) == "frecuencia no conocida"


def test_styles(one):
    assert one(prompts.style_text(F.lit(-3))) == prompts.STYLES[0]
    assert one(prompts.style_text(F.lit(99))) == prompts.STYLES[-1]


def test_prompts(one):
    made = prompts.extraction_prompt("zero_shot", F.lit("M"), F.lit("P"), F.lit("T"))
    assert "principio activo, reacción adversa, frecuencia, trastorno" in one(made)
    with pytest.raises(ValueError):
        prompts.extraction_prompt("other", F.lit("M"), F.lit("P"), F.lit("T"))
    assert one(prompts.compose_document(F.lit("t"), F.col("s")), s=["a", "b"]) == "t\n\n1. a\n2. b"


@pytest.mark.parametrize("answer,expected", [
    ('x\n```json\n{"a": 1}\n```\ny', '{"a": 1}'),
    ('pre {"a": {"b": 2}} post', '{"a": {"b": 2}}'),
    ("none", None),
    ("{broken", None),
    ('{"a":1},{"b":2}', None),
    ("[1]", None),
])
def test_json_object(one, answer, expected):
    assert one(responses.json_object(F.col("r")), r=answer) == expected


@pytest.mark.parametrize("answer,expected", [
    ("[]", []), ('["x"]', None), ("No JSON", None), ("[{]", None),
    ('```json\n[{"frecuencia": "rara"}]\n```', [{"frecuencia": "rara"}]),
    ('[{"a": "1"}, 2]', None),
])
def test_json_array(one, answer, expected):
    assert one(responses.json_array(F.col("r")), r=answer) == expected


def test_coercion(one):
    answer = '[{"tipo":"react","canonical":"","mention":" x "},{"type":"OTHER","surface":"x"},{"category":"SYS"}]'
    got = one(responses.coerce_entities(responses.json_array(F.col("r"))), r=answer)
    assert [tuple(e) for e in got] == [("REACT", "", "x")]


def test_default_only_when_absent(one):
    cell = F.create_map(F.lit("k"), F.lit(""))
    assert one(responses.with_default(cell, "k", F.lit("d"))) == {"k": ""}
    assert one(responses.with_default(cell, "m", F.lit("d"))) == {"k": "", "m": "d"}
