"""Label arrays of one sentence: vocabulary, repair, spans, alignment. All row-local."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types and the annotation column each is read from.
ENTITY_COLUMNS = {
    "REACT": "reacadv",
    "ACTIVE": "pactivo",
    "FREQ": "frecuencia",
    "SYS": "sistema",
}
IGNORED_ID = -100


def check_types(types: Sequence[str]) -> list[str]:
    """Distinct types in the caller's order; empty or unknown types are an error."""
    if not types:
        raise ValueError("at least one entity type is needed")
    unknown = sorted(set(types) - set(ENTITY_COLUMNS))
    if unknown:
        raise ValueError(f"unknown entity types {unknown}; allowed: {sorted(ENTITY_COLUMNS)}")
    return list(dict.fromkeys(types))


def label_vocabulary(types: Sequence[str]) -> dict[str, int]:
    """'O' is 0, then B- and I- per type in the caller's order."""
    names = ["O"] + [f"{mark}-{t}" for t in check_types(types) for mark in "BI"]
    return {name: index for index, name in enumerate(names)}


def _vocabulary_map(vocabulary: dict, flip: bool) -> Column:
    cells = []
    for label, index in vocabulary.items():
        cells += [F.lit(index), F.lit(label)] if flip else [F.lit(label), F.lit(index)]
    return F.create_map(*cells)


def labels_to_ids(labels: Column, vocabulary: dict[str, int]) -> Column:
    table = _vocabulary_map(vocabulary, flip=False)
    return F.transform(labels, lambda x: F.element_at(table, x))


def ids_to_labels(ids: Column, vocabulary: dict[str, int]) -> Column:
    table = _vocabulary_map(vocabulary, flip=True)
    return F.transform(F.filter(ids, lambda i: i != IGNORED_ID), lambda i: F.element_at(table, i))


def label_types(labels: Column) -> Column:
    """Distinct labels without their B-/I- mark; 'O' stays in."""
    return F.array_distinct(F.transform(labels, lambda x: F.regexp_replace(x, "^[BI]-", "")))


def entity_of(label: Column) -> Column:
    return F.when(label != "O", F.substr(label, F.lit(3)))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _continues(labels: Column, label: Column, i: Column) -> Column:
    """The label to the left belongs to the same entity."""
    return F.coalesce(entity_of(F.get(labels, i - 1)) == entity_of(label), F.lit(False))


def repair_bio(labels: Column) -> Column:
    """Orphan I-X becomes B-X. A repair never changes the entity, so the raw neighbour decides."""

    def fix(items: Column):
        return lambda label, i: F.when(
            label.startswith("I-") & ~_continues(items, label, i),
            F.concat(F.lit("B-"), entity_of(label)),
        ).otherwise(label)

    return bind(labels, lambda items: F.transform(items, fix(items)))


def label_spans(labels: Column) -> Column:
    """array<struct<tag,start,end>>, end exclusive; an orphan I-X opens a span."""

    def cuts(items: Column) -> Column:
        opens = F.transform(
            items,
            lambda x, i: F.when((x == "O") | x.startswith("B-") | ~_continues(items, x, i), i),
        )
        return F.concat(F.filter(opens, lambda i: i.isNotNull()), F.array(F.size(items)))

    def runs(items: Column, edges: Column) -> Column:
        spans = F.transform(
            edges,
            lambda start, k: F.struct(
                entity_of(F.get(items, start)).alias("tag"),
                start.alias("start"),
                F.get(edges, k + 1).alias("end"),
            ),
        )
        return F.filter(spans, lambda s: s["tag"].isNotNull() & s["end"].isNotNull())

    return bind(labels, lambda items: bind(cuts(items), lambda edges: runs(items, edges)))


def align_subwords(piece_counts: Column, ids: Column) -> Column:
    """First piece of a word keeps the id, every other piece is ignored."""
    return F.flatten(
        F.zip_with(
            ids,
            piece_counts,
            lambda label, n: F.concat(
                F.array(label), F.array_repeat(F.lit(IGNORED_ID), n - 1)
            ),
        )
    )


def find_sublist(items: Column, pattern: Column) -> Column:
    """Zero-based positions at which ``pattern`` occurs in ``items``, overlaps included."""

    def search(args: Column) -> Column:
        xs, ps = args["xs"], args["ps"]
        hits = F.transform(xs, lambda _, i: F.when(F.slice(xs, i + 1, F.size(ps)) == ps, i))
        return F.when(F.size(ps) > 0, F.filter(hits, lambda i: i.isNotNull())).otherwise(
            F.expr("cast(array() as array<int>)")
        )

    return bind(F.struct(items.alias("xs"), pattern.alias("ps")), search)
