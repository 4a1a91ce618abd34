"""Example selection and the grouped views prompts are written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.functions.keys import seeded_hash
from glossmark.functions.text import ws_trim
from glossmark.operators.ordering import top_k
from glossmark.operators.quality import frequency_text
from glossmark.session import checkpointed


def candidate_index(annotations: DataFrame, code: str = "codigo") -> DataFrame:
    """code, its distinct frequency categories, their number, and the number of rows.

    Rows are counted per (code, category) first, so a hot code shuffles one row
    per category; the category list is as long as the vocabulary at most.
    """
    cells = annotations.groupBy(
        F.col(code).alias("codigo"), ws_trim(F.coalesce("frecuencia", F.lit(""))).alias("f")
    ).agg(F.count("*").alias("n"))
    return cells.groupBy("codigo").agg(
        F.array_sort(F.collect_list("f")).alias("frecuencias"),
        F.count("*").alias("n_frecuencias"),
        F.sum("n").alias("n_reacciones"),
    )


def greedy_examples(index: DataFrame, n: int = 2, seed: int = 42) -> DataFrame:
    """Pick up to ``n`` codes that add most frequency categories; fewer rows break ties.

    A step takes the best score of 1000 per new category minus the row count, and
    stops when no code reaches -1. Equal scores fall to a seeded digest. Each step
    is one aggregate; the lineage is cut between steps beyond the second.
    """
    digested = index.withColumn("_digest", seeded_hash(seed, F.col("codigo")))
    no_texts = F.expr("cast(array() as array<string>)")
    picks = None
    for step in range(1, n + 1):
        if picks is None:
            covered, left = no_texts, digested
        else:
            seen = picks.agg(F.array_distinct(F.flatten(F.collect_list("frecuencias")))).scalar()
            covered = F.coalesce(seen, no_texts)
            left = digested.join(picks.select("codigo"), "codigo", "left_anti")
        fresh = F.size(F.array_except("frecuencias", covered))
        scored = left.withColumn("score", fresh * 1000 - F.col("n_reacciones")).where("score >= -1")
        best = scored.orderBy(F.desc("score"), F.asc("_digest")).limit(1).select(
            F.lit(step).alias("step"), "codigo", "score", "n_frecuencias", "n_reacciones", "frecuencias"
        )
        picks = best if picks is None else picks.unionByName(best)
        if step >= 2 and step < n:
            picks = checkpointed(picks)
    return picks


def best_candidate(index: DataFrame, preferred: list[str] = (), exclude: str | None = None) -> DataFrame:
    """One row: the first preferred code that exists, else most categories, then fewest rows."""
    usable = index if exclude is None else index.where(F.col("codigo") != exclude)
    order = [F.desc("n_frecuencias"), F.asc("n_reacciones"), F.asc("codigo")]
    if preferred:
        place = F.array_position(F.array(*map(F.lit, preferred)), F.col("codigo"))
        order.insert(0, F.when(place == 0, F.lit(len(preferred) + 1)).otherwise(place))
    return usable.orderBy(*order).limit(1)


def round_robin(
    annotations: DataFrame, code: str, n: int, seed: int, row_id: list[str]
) -> DataFrame:
    """Up to ``n`` complete rows per code, taken in turn from its frequency buckets.

    Only the first ``n`` rows of a bucket can be picked, so each task keeps that
    many per bucket before anything is shuffled.
    """
    full = annotations.where(
        " and ".join(f"coalesce({c}, '') <> ''" for c in ("reacadv", "sistema", "frecuencia"))
    ).withColumn("_row", seeded_hash(seed, *[F.col(c) for c in row_id]))
    in_bucket = top_k(
        full, [code, "frecuencia"], [F.col("_row"), *[F.col(c) for c in row_id]], n, "round"
    ).withColumn("_bucket", seeded_hash(seed, F.col(code), F.col("frecuencia")))
    return top_k(in_bucket, [code], [F.col("round"), F.col("_bucket")], n, "pick").drop("_row", "_bucket")


def reactions_by_group(annotations: DataFrame, order: Column, code: str = "codigo") -> DataFrame:
    """(code, system, frequency) with the sorted distinct reactions and first positions.

    Reactions are made distinct before they are gathered, so repeated rows of a
    hot group never meet in one task.
    """
    keys = [code, "sistema", "frecuencia"]
    known = annotations.where(F.col("sistema").isNotNull() & F.col("frecuencia").isNotNull())
    distinct = known.groupBy(*keys, ws_trim(F.coalesce("reacadv", F.lit(""))).alias("r")).agg(
        F.min(order).alias("_first")
    )
    return distinct.groupBy(*keys).agg(
        F.min("_first").alias("first_seen"),
        F.array_sort(F.collect_list(F.nullif(F.col("r"), F.lit("")))).alias("reacciones"),
    ).withColumn("frecuencia_textual", frequency_text(F.col("frecuencia")))


def reaction_table(groups: DataFrame, code: str = "codigo") -> DataFrame:
    """One text per code: system, then frequency with its reactions, in order of appearance."""
    line = F.concat(
        F.lit("  "), "frecuencia_textual", F.lit(": "), F.array_join("reacciones", ", ")
    )
    per_system = groups.groupBy(code, "sistema").agg(
        F.min("first_seen").alias("first_seen"),
        F.array_sort(F.collect_list(F.struct("first_seen", line.alias("line")))).alias("lines"),
    )
    block = F.concat("sistema", F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return per_system.groupBy(code).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_seen", block.alias("block")))), lambda x: x["block"]
            ),
            "\n",
        ).alias("table_text")
    )


def reasoning_text(groups: DataFrame, code: str = "codigo") -> DataFrame:
    """Worked reasoning per code: systems, frequencies per system, reactions per pair (own wording)."""
    per_system = groups.groupBy(code, "sistema").agg(
        F.min("first_seen").alias("first_seen"),
        F.array_sort(F.collect_list("frecuencia")).alias("freqs"),
        F.array_sort(
            F.collect_list(F.struct("first_seen", "frecuencia", F.array_join("reacciones", ", ").alias("list")))
        ).alias("pairs"),
    )
    item = F.struct("first_seen", "sistema", "freqs", "pairs")
    whole = per_system.groupBy(code).agg(F.array_sort(F.collect_list(item)).alias("s"))
    systems = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["sistema"])), "\n")
    frequencies = F.array_join(
        F.transform("s", lambda x: F.concat(F.lit("- "), x["sistema"], F.lit(": "), F.array_join(x["freqs"], ", "))), "\n"
    )
    reactions = F.array_join(
        F.flatten(
            F.transform(
                "s",
                lambda x: F.transform(
                    x["pairs"],
                    lambda p: F.concat(F.lit("- "), x["sistema"], F.lit(" / "), p["frecuencia"], F.lit(": "), p["list"]),
                ),
            )
        ),
        "\n",
    )
    return whole.select(
        code,
        F.concat(
            F.lit("1. Sistemas presentes:\n"), systems,
            F.lit("\n2. Frecuencias de cada sistema:\n"), frequencies,
            F.lit("\n3. Reacciones de cada par:\n"), reactions,
            F.lit("\n4. Resultado en JSON."),
        ).alias("reasoning"),
    )


def gold_answer(annotations: DataFrame, order: list[str], code: str = "codigo") -> DataFrame:
    """(code, position, record): annotation rows in prediction shape, one row each."""
    record = F.to_json(
        F.struct(
            F.coalesce("pactivo", F.lit("")).alias("principio activo"),
            F.coalesce("reacadv", F.lit("")).alias("reacción adversa"),
            F.coalesce("frecuencia", F.lit("")).alias("frecuencia"),
            F.coalesce("sistema", F.lit("")).alias("trastorno"),
        )
    )
    return annotations.select(code, *order, record.alias("record"))


def drug_contexts(annotations: DataFrame, order: list[str]) -> DataFrame:
    """Per code: first medicine name and the sorted distinct active ingredients."""
    actives = (
        annotations.select("codigo", ws_trim(F.col("pactivo")).alias("a"))
        .where(F.coalesce(F.col("a"), F.lit("")) != "")
        .distinct()
        .groupBy("codigo")
        .agg(F.array_sort(F.collect_list("a")).alias("active_ingredients"))
    )
    names = annotations.where(F.coalesce(ws_trim(F.col("medicamento")), F.lit("")) != "").groupBy("codigo").agg(
        F.min_by(ws_trim(F.col("medicamento")), F.struct(*order)).alias("medicamento")
    )
    return names.join(actives, "codigo")
