"""Declared schemas. Codes are strings everywhere, so leading zeros survive."""

from __future__ import annotations

ANNOTATION_COLUMNS = ("codigo", "medicamento", "pactivo", "reacadv", "frecuencia", "sistema")
CANONICAL_COLUMNS = tuple(f"{c}_canonical" for c in ("pactivo", "reacadv", "frecuencia", "sistema"))

ANNOTATIONS = ", ".join(f"{c} string" for c in ANNOTATION_COLUMNS)
SYNTH_ANNOTATIONS = (
    ANNOTATIONS + ", " + ", ".join(f"{c} string" for c in CANONICAL_COLUMNS) + ", orig_codigo string, variante int"
)
ENTITY = "struct<type:string,canonical:string,surface:string,start:int,end:int>"
ENTITY_FILE = (
    "codigo string, variante int, codigo_variant string, medicamento string, discard_ratio double, "
    f"entities array<{ENTITY}>"
)
DOCUMENT = (
    "codigo string, orig_codigo string, variante int, medicamento string, text string, "
    f"discard_ratio float, entities array<{ENTITY}>"
)
PREDICTION = (
    "array<struct<`principio activo`:string,`reacción adversa`:string,frecuencia:string,trastorno:string>>"
)
BIO_SENTENCE = "codigo string, sent_idx int, tokens array<string>, ner_tags array<int>"
SECTION = "seccion string, titulo string, contenido string, orden int"
DRUG_RECORD = (
    "nregistro string, nombre string, pactivos string, labtitular string, cpresc string, "
    "estado struct<aut:bigint>, comerc boolean, receta boolean, generico boolean, conduc boolean, "
    "triangulo boolean, huerfano boolean, biosimilar boolean, notas boolean, psum boolean, "
    "docs array<struct<tipo:int,url:string,secc:boolean,fecha:bigint>>, "
    "atcs array<struct<codigo:string,nombre:string,nivel:int>>, "
    "principiosActivos array<struct<id:int,codigo:string,nombre:string,cantidad:string,unidad:string,orden:int>>, "
    "excipientes array<struct<id:int,nombre:string,cantidad:string,unidad:string,orden:int>>, "
    "viasAdministracion array<struct<id:int,nombre:string>>"
)
