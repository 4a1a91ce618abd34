"""Composed outputs: gold rows of a split, exported examples and their summary, validator section, templated labels."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.functions.labels import ENTITY_COLUMNS, check_types, entity_of, label_vocabulary, labels_to_ids
from glossmark.functions.numeric import ratio
from glossmark.operators.ordering import five_numbers


def gold_rows(full: DataFrame, split: DataFrame, code: str) -> DataFrame:
    """The gold rows of a split's codes, with ``origin``.

    The split says which codes count; their rows come from the full annotation table. Codes that
    table lacks keep the split's own rows, so no code of the split is without gold.
    """
    wanted, known = split.select(code).distinct(), full.select(code).distinct()
    columns = [c for c in full.columns if c in split.columns]
    found = full.join(wanted, code, "left_semi").select(*columns, F.lit("full").alias("origin"))
    own = split.join(known, code, "left_anti").select(*columns, F.lit("split").alias("origin"))
    return found.unionByName(own)


def select_codes(wanted: DataFrame, known: DataFrame, code: str, position: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Wanted codes that are known, in their own order up to ``limit``, and the unknown ones apart."""
    there = known.select(code).distinct()
    chosen = wanted.join(there, code, "left_semi")
    unknown = wanted.join(there, code, "left_anti")
    return (chosen.orderBy(position, code).limit(limit) if limit is not None else chosen), unknown


def hallucinations_per_code(invented: DataFrame, code: str, shown: str) -> DataFrame:
    """Per code: how many invented predictions it has, and the distinct invented values in order."""
    return invented.groupBy(code).agg(
        F.count("*").alias("hallucinated"), F.array_join(F.array_sort(F.collect_set(shown)), "|").alias("names"))


def hallucination_payload(invented: DataFrame, code: str, columns: dict[str, str]) -> DataFrame:
    """(code, entry): each invented prediction in export shape, as JSON.

    ``columns`` maps our names to those of the export; a missing cell is an empty text. Rows stay apart, so that a code with
    many of them is no group; their number is in ``hallucinations_per_code``.
    """
    entry = F.struct(*[F.coalesce(F.col(own), F.lit("")).alias(theirs) for own, theirs in columns.items()])
    return invented.select(F.col(code).cast("string").alias(code), F.to_json(entry).alias("entry"))


def label_mapping(types: Sequence[str]) -> dict:
    """The label vocabulary of a config in the shape that trainers read."""
    ids = label_vocabulary(types)
    return {"entity_types": list(check_types(types)), "label_to_id": ids, "id_to_label": {str(i): label for label, i in ids.items()}}


def config_examples(sentences: DataFrame, labels: str, configs: Sequence[Sequence[str]]) -> DataFrame:
    """One row per sentence and config: ``config``, labels of its types only, and their ids in its vocabulary.

    Configs are a literal array, exploded.
    """
    names = ["-".join(check_types(types)).lower() for types in configs]
    table = F.array(*[
        F.struct(F.lit(n).alias("config"), F.array(*map(F.lit, types)).alias("types")) for n, types in zip(names, configs, strict=True)])
    rows = sentences.withColumn("_c", F.explode(table)).withColumn("config", F.col("_c.config"))
    kept = F.transform(labels, lambda x: F.when(F.array_contains("_c.types", entity_of(x)), x).otherwise("O"))
    ids = None
    for name, types in zip(names, configs, strict=True):
        made = labels_to_ids(F.col(labels), label_vocabulary(types))
        ids = F.when(F.col("config") == name, made) if ids is None else ids.when(F.col("config") == name, made)
    return rows.withColumn(labels, kept).withColumn("ner_tags", ids).drop("_c")


def export_summary(examples: DataFrame, labels: str, document: str, groups: Sequence[str], texts: DataFrame | None = None) -> DataFrame:
    """Per group: documents, sentences, tokens, tagged tokens and their share, untagged documents.

    ``texts`` (document) adds how many exported documents have no text.
    """
    tagged = F.size(F.filter(labels, lambda x: x != "O"))
    per = examples.groupBy(*groups, document).agg(
        F.count("*").alias("s"), F.sum(F.size(labels)).alias("t"), F.sum(tagged).alias("g"))
    if texts is not None:
        per = per.join(texts.select(document, F.lit(True).alias("_text")).distinct(), document, "left")
    out = per.groupBy(*groups).agg(
        F.count("*").alias("documents"), F.sum("s").alias("sentences"), F.sum("t").alias("tokens"), F.sum("g").alias("tagged_tokens"),
        F.bround(ratio(F.sum("g"), F.sum("t")), 6).alias("tagged_share"),
        F.count(F.when(F.col("g") == 0, 1)).alias("untagged_documents"),
        *([F.count(F.when(F.col("_text").isNull(), 1)).alias("missing_texts")] if texts is not None else []))
    return out


def label_counts(examples: DataFrame, labels: str, groups: Sequence[str]) -> DataFrame:
    """Label counts per group."""
    return examples.select(*groups, F.explode(labels).alias("label")).groupBy(*groups, "label").agg(F.count("*").alias("n"))


def config_label_counts(counts: DataFrame, configs: Sequence[Sequence[str]], groups: Sequence[str]) -> DataFrame:
    """Label counts per config and group as ``label_counts`` of ``config_examples`` gives them, from counts (groups, label, n)
    of the unfiltered labels: a config changes labels alone, so no sentence is repeated for it."""
    table = F.array(*[F.struct(F.lit("-".join(check_types(types)).lower()).alias("config"), F.array(*map(F.lit, types)).alias("types")) for types in configs])
    kept = F.when(F.array_contains("_c.types", entity_of(F.col("label"))), F.col("label")).otherwise("O")
    summed = counts.groupBy(*groups, "label").agg(F.sum("n").alias("n")).withColumn("_c", F.explode(table))
    return summed.select(F.col("_c.config").alias("config"), *groups, kept.alias("label"), "n").groupBy("config", *groups, "label").agg(F.sum("n").alias("n"))


def config_id_texts(sentences: DataFrame, labels: str, document: str, position: str, configs: Sequence[Sequence[str]]) -> DataFrame:
    """(document, config, ids): the label ids of a document's sentences in order, as ``config_examples`` gives them; ids are
    joined by commas, sentences by semicolons.

    Every label is one letter until a document's sentences are together; each config only rewrites letters to its ids, which
    have one digit. Labels of no type count as O.
    """
    every = label_vocabulary(list(ENTITY_COLUMNS))
    letters = {label: chr(ord("a") + i) for label, i in every.items()}
    known = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    text = F.array_join(F.transform(labels, lambda x: F.coalesce(F.element_at(known, x), F.lit(letters["O"]))), ",")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text.alias("ids")))), lambda s: s["ids"]), ";")
    marks = "".join(letters.values())
    made = F.array(*[F.struct(F.lit("-".join(check_types(types)).lower()).alias("config"), F.translate(
        "_ids", marks, "".join(str(label_vocabulary(types).get(label, 0)) for label in letters)).alias("ids")) for types in configs])
    return sentences.groupBy(document).agg(whole.alias("_ids")).select(document, F.explode(made).alias("_c")).select(document, "_c.config", "_c.ids")


def validator_section(outcome: DataFrame, ratio_column: str = "discard_ratio") -> DataFrame:
    """One row over documents with a discard ratio: five numbers, and how many discard nothing."""
    some = outcome.where(F.col(ratio_column).isNotNull())
    numbers = five_numbers(some, ratio_column)
    zero = some.agg(F.count(F.when(F.col(ratio_column) == 0, 1)).alias("zero"))
    return numbers.select("n", "min", "p25", "median", "p75", "max", zero.scalar().alias("zero"))


def entities_by_type(entities: DataFrame, document: str) -> DataFrame:
    """Entities and documents that hold one, by type."""
    return entities.groupBy("type").agg(F.count("*").alias("entities"), F.countDistinct(document).alias("documents"))


def templated_labels(words: Column, values: Sequence[tuple[str, Column]]) -> Column:
    """Label array of a sentence's words: every occurrence of each value's words, later types over earlier ones."""
    names = [name for name, _ in values]

    @F.arrow_udf("array<string>")
    def laid(lists: pa.Array, *texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(lists), 4096):
            cells = (column.slice(at, 4096).to_pylist() for column in (lists, *texts))
            out.append(pa.array([_laid_over(row, names, found) for row, *found in zip(*cells, strict=True)], pa.list_(pa.string())))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return laid(words, *[value for _, value in values])


def _laid_over(words: list[str] | None, names: Sequence[str], values: Sequence[str | None]) -> list[str] | None:
    if words is None:
        return None
    labels = ["O"] * len(words)
    for name, value in zip(names, values, strict=True):
        pattern = [w for w in (value or "").split(" ") if w]
        size = len(pattern)
        if not size or pattern[0] not in words:
            continue
        starts = [i for i in range(len(words) - size + 1) if words[i] == pattern[0] and words[i:i + size] == pattern]
        for i in starts:
            labels[i:i + size] = [f"I-{name}"] * size
        for i in starts:
            labels[i] = f"B-{name}"
    return labels


def check_generation(variants: int, attempts: int, max_discard: float, temperature: float) -> None:
    """Parameters of a generation run that make no sense are an error."""
    if variants < 1 or attempts < 1:
        raise ValueError("variants and attempts must be 1 or more")
    if not 0.0 <= max_discard <= 1.0:
        raise ValueError("the discard limit must lie in [0, 1]")
    if temperature < 0.0:
        raise ValueError("temperature must not be negative")
