"""Text normalisation, object families and open-data text rules as native expressions."""

from __future__ import annotations

import itertools
import re
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
STOP_WORDS = [
    "de", "del", "la", "las", "el", "los", "y", "e", "para", "por", "con",
    "en", "a", "un", "una", "unos", "unas", "servicio", "servicios",
    "adquisicion", "adquisiciones", "contratacion", "contrataciones",
    "compra", "compras", "obra", "obras", "publica", "publico",
    "preventivo", "preventiva", "preventivos", "preventivas",
    "correctivo", "correctiva", "correctivos", "correctivas",
]
SYNONYMS = {
    "conservacion": "mantenimiento",
    "conservar": "mantenimiento",
    "mantenimientos": "mantenimiento",
    "vias": "via",
    "vial": "via",
    "viales": "via",
    "carretera": "via",
    "carreteras": "via",
    "equipos": "equipo",
    "informaticos": "informatico",
    "informaticas": "informatico",
    "materiales": "material",
}
NO_CATEGORY = "sin_categoria"
NO_OBJECT = "__SIN_OBJETO__"
OBJECT_CATEGORIES = [
    ("Salud y medicamentos", r"salud|m[ée]dic|hospital|medicamento|farmac|quir[uú]rgic|cl[ií]nic|sanitari|reactivo|laboratorio|inmunohematolog|traslado.*pacientes"),
    ("Mantenimiento de infraestructura", r"mantenimiento|reparaci[oó]n"),
    ("Obra vial y construcción", r"\bobra\b|v[ií]al|carretera|pavimenta|construcci[oó]n|rehabilitaci[oó]n.*(?:vial|carretera|obra)"),
    ("Limpieza y vigilancia", r"limpieza|vigilancia|seguridad f[ií]sica|guardian[ií]a|residuos s[oó]lidos"),
    ("Equipos informáticos y tecnología", r"inform[aá]tic|computad|software|licencia.*(microsoft|windows)|tecnolog[ií]a"),
    ("Consultoría y servicios profesionales", r"consultor[ií]a|asesor[ií]a|perito|honorarios profesionales|expediente t[eé]cnico|notificaci[oó]n"),
    ("Alimentación", r"aliment|v[ií]veres|raciones|desayuno escolar|qali warma|leche evaporada"),
    ("Transporte y combustible", r"transporte|combustible|gasolina|petr[oó]leo|flete"),
    ("Capacitación", r"capacitaci[oó]n|curso|taller de formaci[oó]n"),
    ("Vestuario y uniformes", r"uniforme|vestuario|indumentaria"),
    ("Materiales de construcción", r"cemento|fierro|agregado|material.*construcci[oó]n|arena|hormig[oó]n|ladrillo|brida"),
    ("Bienes de oficina", r"[uú]til.*oficina|papeler[ií]a|mobiliario"),
    ("Agropecuario", r"agr[ií]cola|agropecuario|semilla|hijuelo|pesca artesanal|tractor"),
    ("Maquinaria y equipos", r"maquinaria|equipo.*producci[oó]n|generador|motor"),
]
OTHER_CATEGORY = "Otros bienes y servicios"
CONSORTIUM_PATTERN = r"\bCONSORCIO\b"
ROLE_BOUNDARY = r"[,;\s\[\]'\"]"
# ----------------------------------------------------------------------------

# Word boundaries and letters by Unicode; the dot stops at a line feed only.
_REGEX_FLAGS = "(?Ud)"


def _compatibility_letters() -> tuple[str, str]:
    """Characters with a one-letter ASCII base form, then all combining marks."""
    source, target, marks = [], [], []
    for code in range(0x80, 0xFFFF):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            source.append(char)
            target.append(base.lower())
    return "".join(source + marks), "".join(target)


_FROM, _TO = _compatibility_letters()


def strip_accents(text: Column) -> Column:
    """Lower-cased, trimmed text with base letters in place of accented ones."""
    return F.translate(F.lower(F.trim(text.cast("string"))), _FROM, _TO)


def normalize_text(text: Column) -> Column:
    """Letters and digits of `text` in single-space-separated words; null becomes empty."""
    words = F.regexp_replace(strip_accents(text), "[^a-z0-9]+", " ")
    return F.coalesce(F.trim(words), F.lit(""))


def _word_list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _canonical_word(word: Column) -> Column:
    mapped = word
    for variant, preferred in SYNONYMS.items():
        mapped = F.when(word == variant, F.lit(preferred)).otherwise(mapped)
    return mapped


def tokens_filtered(text: Column) -> Column:
    """Meaningful words in their order, with controlled synonyms applied."""
    words = F.split(normalize_text(text), " ")
    kept = F.filter(words, lambda w: ~w.isin("", *STOP_WORDS))
    return F.filter(F.transform(kept, _canonical_word), lambda w: ~w.isin(*STOP_WORDS))


def _preferred_words(words: Column) -> Column:
    """Distinct words with variants replaced, by set operations that stay in generated code."""
    variants: dict[str, list[str]] = {}
    for variant, preferred in SYNONYMS.items():
        variants.setdefault(preferred, []).append(variant)
    none = F.array().cast("array<string>")
    found = [
        F.when(F.arrays_overlap(words, _word_list(listed)), F.array(F.lit(preferred))).otherwise(none)
        for preferred, listed in variants.items()
    ]
    return F.array_union(F.array_except(words, _word_list(list(SYNONYMS))), F.concat(*found))


def object_family(text: Column, category: Column | None = None) -> Column:
    """Signature of an object text: category and its sorted distinct meaningful words."""
    drop = _word_list(["", *STOP_WORDS])
    words = F.array_except(F.split(normalize_text(text), " "), drop)
    words = F.sort_array(F.array_except(_preferred_words(words), drop))
    signature = F.nullif(F.array_join(words, "|"), F.lit(""))
    group = F.lit(None).cast("string") if category is None else F.nullif(normalize_text(category), F.lit(""))
    return F.concat(
        F.coalesce(group, F.lit(NO_CATEGORY)), F.lit("::"), F.coalesce(signature, F.lit(NO_OBJECT))
    )


def _fragments(pattern: str) -> list[str]:
    """Texts of which every match of the pattern holds at least one: how each alternative begins, letter classes spelt out."""
    found = []
    for alternative in re.split(r"\|(?![^(]*\))", pattern):
        start = re.split(r"[.(]", alternative.replace(r"\b", ""))[0]
        choices = [letters.strip("[]") for letters in re.findall(r"\[[^\]]*\]|.", start)]
        found += ["".join(chosen) for chosen in itertools.product(*choices)]
    return found


def categorize_text(description: Column) -> Column:
    """First category, in order, whose pattern occurs in the lower-cased text.

    A pattern is only tried on texts that hold one of its fragments, a plain search of bytes.
    """
    text = F.lower(description.cast("string"))
    matches = [
        F.when(reduce(or_, [text.contains(f) for f in _fragments(pattern)]) & text.rlike(_REGEX_FLAGS + pattern), F.lit(name))
        for name, pattern in OBJECT_CATEGORIES
    ]
    return F.coalesce(*matches, F.lit(OTHER_CATEGORY))


def role_contains(roles: Column, role: str) -> Column:
    """Whether a serialised list holds `role`, whatever its order and quoting."""
    if not role.isalnum():
        raise ValueError(f"a role is letters and digits only: {role!r}")
    pattern = f"(?:^|{ROLE_BOUNDARY}){role}(?:$|{ROLE_BOUNDARY})"
    return F.coalesce(roles.cast("string").rlike(pattern), F.lit(False))


def consortium_flag(name: Column) -> Column:
    """Whether a name has the word CONSORCIO, in any case."""
    return F.coalesce(name.cast("string").rlike("(?iU)" + CONSORTIUM_PATTERN), F.lit(False))
