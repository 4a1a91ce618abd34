"""Dictionary mentions in text: collection, occurrence search, overlap resolution, projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from glossmark.functions.labels import ENTITY_COLUMNS, check_types, entity_of
from glossmark.functions.text import fold, ws_trim
from glossmark.operators.automaton import Chooser, Finder, chosen, priority
from glossmark.operators.tokens import bio_tokens, edges_of, in_rows, pattern_pieces, row_slices

# Singular and plural surface forms of the frequency categories.
FREQUENCY_FORMS = (
    ("frecuente", "frecuentes"),
    ("muy frecuente", "muy frecuentes"),
    ("poco frecuente", "poco frecuentes"),
)

#: A code's documents are dealt in parts of about so many, or of so many that no more than ``MOST_HOT`` codes have several.
PART_DOCUMENTS, MOST_HOT = 250, 4_096
_CHOICES = pa.list_(pa.struct([(c, pa.int32() if c in ("start", "end") else pa.string()) for c in ("config", "type", "mention", "start", "end")]))
_SPANS = "array<struct<type:string,type_rank:int,mention:string,start:int,end:int>>"


def collect_mentions(annotations: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """(key, type, mention): distinct trimmed values per key and type, frequency pairs completed."""
    wanted = check_types(types)
    pairs = F.array(*[
        F.struct(F.lit(t).alias("type"), ws_trim(F.col(ENTITY_COLUMNS[t])).alias("mention"))
        for t in wanted
    ])
    listed = (
        annotations.where(F.col(key).isNotNull())
        .select(key, F.explode(pairs).alias("m"))
        .select(key, "m.type", "m.mention")
        .where(F.col("mention").isNotNull() & (F.col("mention") != ""))
        .distinct()
    )
    return complete_frequency_pairs(listed, key) if "FREQ" in wanted else listed


def complete_frequency_pairs(mentions: DataFrame, key: str) -> DataFrame:
    """Add the other form of a frequency pair when either form is listed under FREQ."""
    other = F.array_compact(F.array(*[
        F.when(fold(F.col("mention")).isin(*forms), F.lit(form))
        for forms in FREQUENCY_FORMS
        for form in forms
    ]))
    all_forms = F.when(F.col("type") == "FREQ", F.array_union(F.array("mention"), other)).otherwise(
        F.array("mention")
    )
    return mentions.select(key, "type", F.explode(all_forms).alias("mention")).distinct()


def search(
    docs: DataFrame,
    mentions: DataFrame,
    doc_key: str,
    code: str,
    types: Sequence[str],
    mention_code: str | None = None,
    text: str = "text",
    resolve: bool = False,
    first: bool = False,
) -> DataFrame:
    """``docs`` with ``spans``: every bounded occurrence of its code's mentions, as they end, with ``resolve`` the
    non-overlapping choice in text order, or with ``first`` the leftmost one of each mention.

    Documents are dealt by code, large codes in parts, and meet their code's mentions in the same task: these come first
    and are compiled once into an automaton with failure links, which reads each text in one pass. A text is
    shuffled once; nothing is made for places without a mention. Rows of a null code, and of a code without mentions,
    have no spans.
    """
    wanted = check_types(types)
    rank = F.array_position(F.array(*[F.lit(t) for t in wanted]), F.col("type")) - 1
    words = mentions.where(F.col("type").isin(*wanted) & F.col("mention").isNotNull()).groupBy(
        F.col(mention_code or code).cast("string").alias("_code")
    ).agg(F.collect_set(F.struct("type", rank.cast("int").alias("rank"), "mention")).alias("_words")).where("_code IS NOT NULL")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(code).cast("string").alias("_code"), F.col(text).alias("_text"), F.col(doc_key).alias("_key"))
    counts = rows.where("_code IS NOT NULL").groupBy("_code").agg(F.count("*").alias("_n"))
    size = max(PART_DOCUMENTS, (counts.agg(F.sum("_n")).first()[0] or 0) // MOST_HOT + 1)
    parts = F.broadcast(counts.where(F.col("_n") > size).select("_code", F.ceil(F.col("_n") / size).cast("int").alias("_parts")))
    n_parts = F.coalesce("_parts", F.lit(1))
    asked = rows.join(parts, "_code", "left").select(
        "_code", F.pmod(F.xxhash64("_key"), n_parts).cast("int").alias("_part"), F.lit(1).alias("_kind"), "_row", "_text")
    told = words.join(parts, "_code", "left").select("_code", "_words", F.lit(0).alias("_kind"), F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("_part"))
    # rows without a code need no company
    deal = F.coalesce("_part", F.lit(0))
    met = asked.unionByName(told, allowMissingColumns=True).withColumn("_part", F.when(F.col("_code").isNull(), F.pmod(F.xxhash64("_text"), F.lit(MOST_HOT)).cast("int")).otherwise(deal))
    kind = rows.schema["_row"].dataType.simpleString()
    found = met.repartition("_code", "_part").sortWithinPartitions("_code", "_part", "_kind").mapInArrow(_searched(resolve, first), f"_row {kind}, spans {_SPANS}")
    return found.select("_row.*", "spans")


def _searched(resolve: bool, first: bool):
    """Rows by code and part, mentions before documents, to the documents with their spans."""
    def run(batches):
        now, finder = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys = zip(*(batch.column(c).to_pylist() for c in ("_code", "_part", "_kind", "_text")), strict=True)
                # which of the words of the batch's finders, one after the other, each span is
                words, offset = (finder.words[:], 0) if finder else ([], 0)
                here, found = [], []
                for i, (code, part, kind, text) in enumerate(keys):
                    if kind == 0:
                        now = (code, part)
                        finder = Finder([(w["type"], w["rank"], w["mention"]) for w in batch.column("_words")[i].as_py()])
                        offset = len(words)
                        words += finder.words
                        continue
                    here.append(i)
                    if code is None or now != (code, part):
                        found.append(_NONE)
                        continue
                    if resolve:
                        which, start, end = _resolved(finder, text)
                    else:
                        which, start, end = finder.leftmost(text) if first else finder.places(text)
                    found.append((which + offset, start, end))
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(here, pa.int64())), _span_lists(words, found)], names=["_row", "spans"])

    return run


_NONE = (np.empty(0, np.int64),) * 3


def _resolved(finder: Finder, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The non-overlapping choice of a text in text order."""
    which, start, end = finder.places(text)
    cells = [(*finder.words[k], s, e, i) for i, (k, s, e) in enumerate(zip(which.tolist(), start.tolist(), end.tolist(), strict=True))]
    stay = np.array([span[-1] for span in chosen(cells)], np.int64)
    return which[stay], start[stay], end[stay]


def _span_lists(words: list[tuple[str, int, str]], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    which, start, end = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))
    kinds = (pa.string(), pa.int32(), pa.string())
    columns = [pa.array([w[k] for w in words], t).take(pa.array(which)) for k, t in enumerate(kinds)]
    values = pa.StructArray.from_arrays([*columns, pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["type", "type_rank", "mention", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32()), values)


def find_spans(
    docs: DataFrame,
    mentions: DataFrame,
    doc_key: str,
    code: str,
    types: Sequence[str],
    mention_code: str | None = None,
    text: str = "text",
    first: bool = False,
) -> DataFrame:
    """Every bounded occurrence of a code's mentions in that code's documents, or with ``first`` the leftmost of each mention
    in each row, from ``search``.

    Returns doc_key, code, type, type_rank, mention, mention_length, start, end.
    """
    keys = [doc_key] if code == doc_key else [doc_key, code]
    found = search(docs.select(*keys, text), mentions, doc_key, code, types, mention_code, text, first=first)
    return found.select(*keys, F.explode("spans").alias("_s")).select(
        *keys, "_s.type", "_s.type_rank", "_s.mention", F.length("_s.mention").alias("mention_length"), "_s.start", "_s.end")


def resolve_overlaps(spans: DataFrame, doc_key: str) -> DataFrame:
    """Keep a non-overlapping set: type order first, then longer mentions, then text order.

    Spans are dealt by document and read in priority order; of the spans taken so far only the ordered interval set of the
    document at hand is held, and one neighbour in it decides.
    """
    doc = F.struct(F.col(doc_key).alias("key"))
    rows = spans.select(doc.alias("_doc"), F.to_json(doc).alias("_id"), "type", "type_rank", "mention", "start", "end")
    kind = rows.schema["_doc"].dataType.simpleString()
    order = ["_id", "type_rank", F.desc(F.length("mention")), "mention", "start", "end", "type"]

    def run(batches):
        now, chooser = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                columns = (batch.column(c).to_pylist() for c in ("_id", "type_rank", "mention", "start", "end"))
                stays = []
                for doc, rank, mention, start, end in zip(*columns, strict=True):
                    if chooser is None or doc != now:
                        now, chooser = doc, Chooser()
                    stays.append(chooser.takes(rank, mention, start, end))
                yield batch.select(["_doc", "type", "mention", "start", "end"]).filter(pa.array(stays, pa.bool_()))

    met = rows.repartition("_id").sortWithinPartitions(*order)
    return met.mapInArrow(run, f"_doc {kind}, type string, mention string, start int, end int").select(
        F.col("_doc.key").alias(doc_key), "type", "mention", "start", "end")


def resolve_configs(spans: Column, configs: Mapping[str, Sequence[str]]) -> Column:
    """array<struct<config,type,mention,start,end>>: the non-overlapping choice of each config among the spans of its types.

    ``spans`` is the column that ``search`` gives without ``resolve``. A document's spans are put in priority order once, and
    every config reads them inside the document's row: no span is repeated or shuffled for a config.
    """
    wanted = {name: frozenset(check_types(types)) for name, types in configs.items()}

    @F.arrow_udf("array<struct<config:string,type:string,mention:string,start:int,end:int>>")
    def choose(rows: pa.Array) -> pa.Array:
        out = []
        for part in row_slices(np.diff(edges_of(rows)), 1 << 16):
            here = rows[part]
            found, edges = here.flatten(), edges_of(here).tolist()
            cells = list(zip(*(found.field(c).to_pylist() for c in ("type", "type_rank", "mention", "start", "end")), strict=True))
            names, picks, upto = [], [], [0]
            for begin, end in zip(edges, edges[1:]):
                order = sorted(range(begin, end), key=lambda k: priority(cells[k]))
                for name, types in wanted.items():
                    chooser = Chooser()
                    stay = [k for k in order if cells[k][0] in types and chooser.takes(*cells[k][1:])]
                    names += [name] * len(stay)
                    picks += stay
                upto.append(len(picks))
            picked = found.take(pa.array(picks, pa.int64()))
            columns = {"config": pa.array(names, pa.string()), **{c: picked.field(c) for c in ("type", "mention", "start", "end")}}
            values = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
            out.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values))
        return pa.concat_arrays(out) if out else pa.array([], _CHOICES)

    return choose(spans)


def first_occurrences(spans: DataFrame, *keys: str) -> DataFrame:
    """Leftmost occurrence per key set, e.g. (document, mention)."""
    return spans.groupBy(*keys).agg(F.min_by("end", "start").alias("end"), F.min("start").alias("start"))


def project_labels(tokens: DataFrame, spans: DataFrame, doc_key: str) -> DataFrame:
    """Label of each token: what stands at its first character, then I to B where nothing precedes.

    Spans and tokens are ordered together by position; the last span at or
    before a token decides, so no range join is needed.
    """
    span_rows = spans.select(
        doc_key,
        F.col("start").alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct("start", "end", "type").alias("_span"),
        F.lit(None).cast("struct<idx:int,token:string,end:int,sent_idx:int>").alias("_token"),
    )
    token_rows = tokens.select(
        doc_key,
        F.col("start").alias("_at"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast("struct<start:int,end:int,type:string>").alias("_span"),
        F.struct("idx", "token", "end", "sent_idx").alias("_token"),
    )
    in_order = Window.partitionBy(doc_key).orderBy("_at", "_kind")
    carried = F.last("_span", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    at_start = (
        F.when(F.col("_last.end") <= F.col("_at"), F.lit("O"))
        .when(F.col("_last.start") == F.col("_at"), F.concat(F.lit("B-"), F.col("_last.type")))
        .when(F.col("_last.end") > F.col("_at"), F.concat(F.lit("I-"), F.col("_last.type")))
        .otherwise(F.lit("O"))
    )
    raw = (
        span_rows.unionByName(token_rows)
        .withColumn("_last", carried)
        .where(F.col("_kind") == 1)
        .select(
            doc_key, "_token.idx", "_token.token", F.col("_at").alias("start"), "_token.end", "_token.sent_idx",
            at_start.alias("_raw"),
        )
    )
    by_place = Window.partitionBy(doc_key).orderBy("start")
    before = F.when(F.lag("sent_idx").over(by_place) == F.col("sent_idx"), F.lag("_raw").over(by_place))
    orphan = F.col("_raw").startswith("I-") & ~F.coalesce(
        entity_of(before) == entity_of(F.col("_raw")), F.lit(False)
    )
    label = F.when(orphan, F.concat(F.lit("B-"), entity_of(F.col("_raw")))).otherwise(F.col("_raw"))
    return raw.withColumn("label", label).drop("_raw")


def label_documents(found: DataFrame, doc_key: str, text: str = "text", *keep: str, cut: Callable[[Column], Column] = pattern_pieces) -> DataFrame:
    """Labelled tokens of documents with resolved ``spans`` (of ``search``): key, kept columns, idx, token, start, end,
    sent_idx, label.

    The document's sorted spans and its token array are merged inside its row; no token is shuffled or sorted. ``cut`` is the
    tokenizer, by pattern or by word rules (``word_rules.word_pieces``).
    """
    return bio_tokens(found, doc_key, text, *keep, spans="spans", cut=cut)


@F.arrow_udf(ArrayType(StringType()))
def _slices(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """What a text holds at each of its spans, a few texts at a time."""
    found = spans.flatten()
    first, end, edges = *(found.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end")), edges_of(spans)
    parts = [
        pa.array([text[first[k]:end[k]] for row, text in enumerate(texts.slice(at, 64).to_pylist(), at) for k in range(edges[row], edges[row + 1])], pa.string())
        for at in range(0, len(texts), 64)]
    return in_rows(pa.concat_arrays(parts) if parts else pa.array([], pa.string()), spans)


def span_surfaces(found: DataFrame, doc_key: str, text: str = "text", *keep: str) -> DataFrame:
    """One row per span of ``search``: key, kept columns, type, mention, start, end, and ``surface``, what the text holds there.

    The surface is cut inside the document's row, so no text is repeated or joined.
    """
    cells = F.arrays_zip(F.col("spans").alias("s"), _slices(F.coalesce(F.col(text), F.lit("")), F.col("spans")).alias("surface"))
    return found.select(doc_key, *keep, F.explode(cells).alias("_c")).select(
        doc_key, *keep, "_c.s.type", "_c.s.mention", "_c.s.start", "_c.s.end", "_c.surface")


def offset_integrity(found: DataFrame, doc_key: str, text: str = "text") -> DataFrame:
    """Per type: spans, and those whose text doesn't fold to the folded mention."""
    return span_surfaces(found, doc_key, text).groupBy("type").agg(
        F.count("*").alias("spans"), F.count(F.when(fold(F.col("surface")) != fold(F.col("mention")), 1)).alias("mismatches"))


def sentence_rows(labelled: DataFrame, doc_key: str) -> DataFrame:
    """One example per sentence: key, sent_idx, tokens, labels (arrays in token order)."""
    cells = F.array_sort(F.collect_list(F.struct("idx", "token", "label")))
    return (
        labelled.groupBy(doc_key, "sent_idx")
        .agg(cells.alias("_cells"))
        .select(
            doc_key,
            "sent_idx",
            F.transform("_cells", lambda c: c["token"]).alias("tokens"),
            F.transform("_cells", lambda c: c["label"]).alias("labels"),
        )
    )
