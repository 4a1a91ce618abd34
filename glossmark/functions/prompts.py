"""Prompt texts as expressions. The wording is this library's own."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency categories an answer may use.
FREQUENCY_CATEGORIES = (
    "Muy frecuentes (≥1/10)",
    "Frecuentes (≥1/100 a <1/10)",
    "Poco frecuentes (≥1/1.000 a <1/100)",
    "Raras (≥1/10.000 a <1/1.000)",
    "Muy raras (<1/10.000)",
    "Frecuencia no conocida (no puede estimarse a partir de los datos disponibles)",
)
# Key names of an extraction record.
RECORD_KEYS = ("principio activo", "reacción adversa", "frecuencia", "trastorno")

STRATEGIES = ("zero_shot", "few_shot", "chain_of_thought")

STYLES = (
    "Redacta de forma sobria y ciñéndote a los términos dados.",
    "Redacta de forma técnica y alterna alguna denominación equivalente.",
    "Redacta con libertad, usando sinónimos junto a la forma dada.",
)


def style_text(index: Column) -> Column:
    """Style by variant index; below the first is the first, beyond the last is the last."""
    last = len(STYLES) - 1
    return F.element_at(F.array(*map(F.lit, STYLES)), F.greatest(F.lit(0), F.least(index, F.lit(last))).cast("int") + 1)


def _task(medicine: Column, active: Column) -> Column:
    return F.concat(
        F.lit("Medicamento: "), medicine, F.lit("\nPrincipio activo: "), active,
        F.lit("\nExtrae cada reacción adversa como objeto JSON con las claves: "),
        F.lit(", ".join(RECORD_KEYS)),
        F.lit(".\nFrecuencias admitidas: " + "; ".join(FREQUENCY_CATEGORIES) + "."),
    )


def extraction_prompt(
    strategy: str, medicine: Column, active: Column, text: Column,
    example_text: Column | None = None, example_json: Column | None = None, reasoning: Column | None = None,
) -> Column:
    """User prompt of one strategy; few-shot and chain-of-thought add a worked example."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; expected one of {STRATEGIES}")
    parts = [_task(medicine, active)]
    if strategy != "zero_shot":
        parts += [F.concat(F.lit("Ejemplo de texto:\n"), example_text)]
    if strategy == "chain_of_thought":
        parts += [F.concat(F.lit("Razonamiento:\n"), reasoning)]
    if strategy != "zero_shot":
        parts += [F.concat(F.lit("Respuesta del ejemplo:\n"), example_json)]
    parts += [F.concat(F.lit("Texto:\n"), text), F.lit("Devuelve solo el array JSON.")]
    return F.concat_ws("\n\n", *parts)


def messages(system: Column, *turns: tuple[str, Column]) -> Column:
    """array<struct<role,content>> opening with the system message."""
    cells = [("system", system), *turns]
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in cells])


def message_text(role: Column, content: Column) -> Column:
    return F.concat(F.lit("["), F.upper(role), F.lit("]\n"), content)


def render_messages(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda m: message_text(m["role"], m["content"])), "\n\n")


def long_document_messages(medicine: Column, actives: Column, table: Column, style: Column) -> Column:
    """Request for a full synthetic section with its declared entities."""
    ask = F.concat(
        F.lit("Escribe una sección de reacciones adversas para "), medicine,
        F.lit(" ("), actives, F.lit(").\n"), style, F.lit("\nTabla:\n"), table,
        F.lit("\nResponde con un objeto JSON: text y entities (type, canonical, surface)."),
    )
    return messages(F.lit("Generas textos clínicos en español."), ("user", ask))


def snippet_messages(active: Column, reaction: Column, frequency: Column, system: Column, style: Column) -> Column:
    """Request for one short sentence about a single reaction."""
    ask = F.concat(
        F.lit("Escribe una frase sobre "), reaction, F.lit(" ("), frequency, F.lit(", "), system,
        F.lit(") con "), active, F.lit(".\n"), style,
        F.lit("\nResponde con un objeto JSON: text y entities (type, canonical, surface)."),
    )
    return messages(F.lit("Generas textos clínicos en español."), ("user", ask))


def compose_document(text: Column, snippets: Column) -> Column:
    """Long text, then the snippets as a numbered list."""
    lines = F.transform(snippets, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.when(F.size(snippets) > 0, F.concat(text, F.lit("\n\n"), F.array_join(lines, "\n"))).otherwise(text)


#: Sentence patterns of the templated corpus; each names the slots it fills.
SENTENCE_PATTERNS = (
    "Ficha de {medicine}: principio {active}, efecto {reaction}, grupo {system}, incidencia {frequency}.",
    "En el grupo {system} consta {reaction} con incidencia {frequency}",
    "{reaction} obliga a vigilar a quien recibe {medicine}",
    "Incidencia {frequency} de {reaction} entre pacientes tratados con {active}.",
    "El prospecto de {medicine} recoge {reaction} ({system})",
)


def template_sentences(active: Column, medicine: Column, reaction: Column, frequency: Column, system: Column) -> Column:
    """One sentence per pattern about one annotation row."""
    slots = {"active": active, "medicine": medicine, "reaction": reaction, "frequency": frequency, "system": system}

    def filled(pattern: str) -> Column:
        pieces = re.split(r"\{(\w+)\}", pattern)
        return F.concat(*[slots[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])

    return F.array(*[filled(p) for p in SENTENCE_PATTERNS])
